"""Column expressions and parameter rules."""
