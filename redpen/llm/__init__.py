"""Operators for large text corpora: deduplication, filtering, scoring, mixing, encoding and search."""
