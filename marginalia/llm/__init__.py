"""Operators for preparing training data: deduplication, mixing, packing, extraction and search.

Nothing else in the package imports this subpackage.
"""
