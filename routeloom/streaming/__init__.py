"""Incremental use: evidence that arrives over time."""
