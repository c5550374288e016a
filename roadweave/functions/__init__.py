"""Column expressions: geometry, speeds, text."""
