"""Column builders: coordinates, patterns, ranges and text rules."""
