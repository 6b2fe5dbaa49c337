"""Distributed plans: mergeable moments of rows, and the shape of panels."""
