"""Bindings to the stand-in tables, report queries and the query catalogue."""
