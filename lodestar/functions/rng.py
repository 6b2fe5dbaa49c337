"""A counter-based generator: the k-th draw is a function of seed and k alone.

Any task can make any draw, so bootstrap weights don't depend on how rows are
partitioned, and SQL can make the same ones.
"""

from __future__ import annotations

import time

import numpy as np

# Fixed values of the SplitMix64 generator.
GAMMA = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

# The six-point weights as the estimators use them (their variance is 13/18), and as published.
WEBB = (-np.sqrt(1.5), -np.sqrt(0.5), -np.sqrt(1 / 6), np.sqrt(1 / 6), np.sqrt(0.5), np.sqrt(1.5))
WEBB_PUBLISHED = (-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5))


def draws(seed: int | np.ndarray, k: np.ndarray) -> np.ndarray:
    """The draws number ``k`` (from 0) of the generator with ``seed``, as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        seeds = np.asarray(seed % (1 << 64) if isinstance(seed, int) else seed).astype(np.uint64)
        z = seeds + (np.asarray(k).astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def weights(method: str, seed: int, k: np.ndarray) -> np.ndarray:
    """Bootstrap weights for the draws ``k``: ``rademacher``, ``webb`` or ``webb_published``."""
    u = draws(seed, k)
    if method == "rademacher":
        return np.where(u & np.uint64(1), 1.0, -1.0)
    table = np.array(WEBB if method == "webb" else WEBB_PUBLISHED)
    return table[(u % np.uint64(6)).astype(np.int64)]


def seed_or_clock(seed: int | None) -> int:
    return time.time_ns() if seed is None else seed
