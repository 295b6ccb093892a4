"""Column functions: time codes, text and geometry."""
