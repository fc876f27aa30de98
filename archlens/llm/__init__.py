"""Operators for preparing training text: deduplication, filtering, token counts and encodings."""
