"""Operators for preparing training data: encoding, scoring, deduplication, search, mixing."""
