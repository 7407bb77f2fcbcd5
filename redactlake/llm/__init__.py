"""Operators that prepare training data: formatting, deduplication, search, scoring, mixing and packing.

Nothing else in the library imports this subpackage.
"""
