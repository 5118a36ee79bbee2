"""Operators for preparing training text: deduplication, filtering, mixing and counting.

Nothing outside this subpackage imports it.
"""
