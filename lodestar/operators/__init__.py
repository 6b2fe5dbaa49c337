"""The estimators."""
