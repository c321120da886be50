"""Column functions that the rules share."""
