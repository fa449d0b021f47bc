"""Structured Streaming forms: W1 index refresh, W2 retry routing."""
