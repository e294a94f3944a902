"""Column functions and fixed patterns."""
