"""Readers of dependency, class and model facts, and writers of reports."""
