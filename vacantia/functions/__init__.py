"""Column functions, each applied to a whole table."""
