"""Operators for preparing training text: mixing, filtering, cleaning, de-duplication, encoding, search.

Nothing outside this package imports it. Names that start with ``__tw`` are reserved for its own columns.
"""
