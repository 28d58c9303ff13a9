"""Operators for training-data corpora: duplicates, filters, mixing, search, tokens."""
