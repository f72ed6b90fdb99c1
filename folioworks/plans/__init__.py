"""plans of the archive engine."""
