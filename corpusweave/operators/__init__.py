"""Operators: each takes and returns DataFrames; no driver-side data loops."""
