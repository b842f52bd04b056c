"""Operators for preparing training data: packing, sharding, mixing, near-duplicates, quality, search and URL rules."""
