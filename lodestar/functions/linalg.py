"""Solving the small symmetric systems of the estimators."""

from __future__ import annotations

import numpy as np

SINGULAR = "Singular matrix: cannot solve linear regression (X'X is not invertible, check for collinearity)"
UNSTABLE = "Numerical instability: NaN or Inf in computation"
#: The ratio of largest to smallest diagonal entry from which a matrix counts as nearly singular.
CONDITION = 1e10


def inverse(gram: np.ndarray, message: str = SINGULAR) -> np.ndarray:
    """The inverse of a positive definite matrix by its Cholesky factor; ValueError with ``message`` if it is none."""
    if not np.isfinite(gram).all():
        raise ValueError(message)
    try:
        lower = np.linalg.cholesky(gram)
    except np.linalg.LinAlgError:
        raise ValueError(message) from None
    half = np.linalg.solve(lower, np.eye(len(gram)))
    return half.T @ half


def solution(inverse_gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    beta = inverse_gram @ right
    if not np.isfinite(beta).all():
        raise ValueError(UNSTABLE)
    return beta


def ill_conditioned(matrix: np.ndarray) -> bool:
    """By the rule of thumb on the diagonal."""
    diagonal = np.diag(matrix)
    return bool(diagonal.min() <= 0 or diagonal.max() / diagonal.min() > CONDITION)


def packed(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle, row by row."""
    return matrix[np.triu_indices(len(matrix))]


def unpacked(upper, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = upper
    return m + np.triu(m, 1).T
