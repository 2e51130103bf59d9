"""streaming of the sighting engine."""
