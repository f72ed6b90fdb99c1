"""operators of the archive engine."""
