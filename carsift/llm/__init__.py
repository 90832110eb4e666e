"""Operators for preparing training data: deduplication, filters, mixing, search, classification and tokenisation.

Nothing else in the package imports this one.
"""
