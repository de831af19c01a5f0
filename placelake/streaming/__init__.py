"""streaming of placelake."""
