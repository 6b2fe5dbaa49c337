"""Estimators over event-time windows of streams."""
