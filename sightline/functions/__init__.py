"""Part of the sightline engine."""
