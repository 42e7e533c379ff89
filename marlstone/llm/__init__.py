"""Operators for preparing training data: dedup, packing, scoring, mixing, search and formatting."""
