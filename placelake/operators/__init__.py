"""operators of placelake."""
