"""plans of placelake."""
