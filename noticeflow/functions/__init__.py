"""Column functions by subject."""
