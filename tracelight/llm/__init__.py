"""Operators for preparing training corpora: dedup, filters, mixing, sharding."""
