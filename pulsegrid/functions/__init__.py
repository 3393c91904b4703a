"""Column functions and fixed registries."""
