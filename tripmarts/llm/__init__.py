"""Operators for training data: tokens, near duplicates, filters, search, formats."""
