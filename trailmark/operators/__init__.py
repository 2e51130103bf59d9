"""operators of the sighting engine."""
