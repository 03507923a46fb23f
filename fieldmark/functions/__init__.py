"""Column expressions: predicates, scalars and vector arithmetic."""
