"""functions of placelake."""
