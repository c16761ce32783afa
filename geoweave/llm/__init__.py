"""Operators for large text corpora: deduplication, filtering, mixing, encoding and archiving."""
