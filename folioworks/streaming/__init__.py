"""streaming of the archive engine."""
