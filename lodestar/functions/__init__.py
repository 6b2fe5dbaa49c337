"""Numerical kernels on NumPy arrays, and expressions built from them."""
