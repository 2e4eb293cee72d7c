"""Column functions on text and URLs."""
