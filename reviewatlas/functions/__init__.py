"""Column functions and small DataFrame building blocks."""
