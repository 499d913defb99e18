"""Column expressions and the text functions that need Python."""
