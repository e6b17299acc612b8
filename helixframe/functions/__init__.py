"""Column builders and dimension tables."""
