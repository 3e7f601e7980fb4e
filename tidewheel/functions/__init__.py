"""Column functions: time, text, numbers."""
