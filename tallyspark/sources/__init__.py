"""Column resolution, readers and writers."""
