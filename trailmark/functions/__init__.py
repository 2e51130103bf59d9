"""functions of the sighting engine."""
