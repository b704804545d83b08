"""Relational operators of notice processing: deduplication, naming, attempts."""
