"""Operators for training data: grouping, top items, frequent items, similar vectors, tokens, mixing, residue. Nothing outside imports this package."""
