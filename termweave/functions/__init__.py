"""Column functions: text, vectors, encoders."""
