"""Column functions: text, vectors, validation."""
