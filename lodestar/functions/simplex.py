"""Minimising quadratic functions over the unit simplex, and projecting onto it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pivots below this make a matrix singular.
PIVOT = 1e-12


@dataclass(frozen=True)
class Solution:
    weights: np.ndarray
    iterations: int
    gap: float
    met: bool


def frank_wolfe(gram: np.ndarray, linear: np.ndarray, ridge: float = 0.0, constant: float = 0.0, max_iter: int = 1000, tol: float = 1e-6) -> Solution:
    """Minimise ``w'Gw - 2w'v + ridge |w|^2 + constant`` over the simplex with steps 2 / (k + 2).

    Starts from equal weights. The objective is looked at where the duality gap
    is the smallest yet and every hundredth step, and what was best then is the
    answer if the relative gap never falls below ``tol``; the current weights
    are, if it does. With a loose tolerance weights depend on that path.
    """
    n = len(linear)
    w = np.full(n, 1.0 / n)
    best, best_gap, best_value = w, np.inf, np.inf
    for k in range(max_iter):
        along = gram @ w + ridge * w
        gradient = 2 * along - 2 * linear
        vertex = int(np.argmin(gradient))
        gap = float(gradient @ w - gradient[vertex])
        if k % 100 == 0 or gap < best_gap:
            if not np.isfinite(w).all():
                raise ValueError("weights are not finite")
            value = float(along @ w - 2 * (w @ linear) + constant)
            if value < best_value:
                best, best_value, best_gap = w, value, gap
        if gap / (abs(max(best_value, 1.0)) + 1e-10) < tol:
            return Solution(w, k, gap, True)
        step = 2.0 / (k + 2.0)
        w = (1 - step) * w
        w[vertex] += step
    return Solution(best, max_iter, best_gap, False)


def project(v: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex: a common amount is taken off and negative entries become zero."""
    down = np.sort(v)[::-1]
    excess = np.cumsum(down) - 1
    rank = np.arange(1, len(v) + 1)
    last = np.flatnonzero(down - excess / rank > 0)[-1]
    return np.maximum(v - excess[last] / (last + 1), 0.0)


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``matrix^-1 right``; ValueError if elimination with row pivots would meet a pivot below ``PIVOT``."""
    m = np.column_stack([matrix, right]).astype(np.float64)
    n = len(matrix)
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if not abs(m[p, k]) >= PIVOT:
            raise ValueError("matrix is singular")
        m[[k, p]] = m[[p, k]]
        m[k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k])
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, -1] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x
