"""Column expressions and small per-row helpers shared by the operators."""
