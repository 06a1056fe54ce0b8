"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface and, at its end, the thin ``opN_...`` query
that applies it to the shipped tables.
"""
