"""Column functions on chips, positions and labels."""
