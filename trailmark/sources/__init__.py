"""sources of the sighting engine."""
