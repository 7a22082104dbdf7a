"""Column expressions and lookup tables."""
