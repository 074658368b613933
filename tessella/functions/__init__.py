"""Column functions: text and extraction."""
