"""Operators for preparing training data: sharding, deduplication, search, filters, tokens, mixing, extraction."""
