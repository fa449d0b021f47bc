"""Composed jobs over the driver tables: derived inputs, the registered
queries and their DuckDB oracle SQL."""
