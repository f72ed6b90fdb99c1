"""functions of the archive engine."""
