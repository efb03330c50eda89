"""Operators for preparing training text: quality, duplicates, mixing, packing, search."""
