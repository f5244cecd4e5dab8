"""Part of the point-cloud engine."""
