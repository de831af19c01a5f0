"""sources of placelake."""
