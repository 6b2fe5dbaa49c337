"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage, so it can be removed
without touching the estimators.
"""
