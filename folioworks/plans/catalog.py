"""Importing this module registers every query of the archive engine."""

from folioworks.plans import changes, desk, finding, library, registry, running, searching, streams, trade, whole  # noqa: F401
