"""Column functions: text, time, images."""
