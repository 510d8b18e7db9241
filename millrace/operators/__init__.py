"""Relational operators: contracts, duplicates, splits, history, metrics."""
