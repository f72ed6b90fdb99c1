"""sources of the archive engine."""
