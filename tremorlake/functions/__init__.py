"""Column expressions: positions, times, numbers, text and messages."""
