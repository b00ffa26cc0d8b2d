"""Operators for preparing training data: counting, deduplication, filtering, scoring, search and packing."""
