"""Arguments, cluster scores and standard errors that both regressions share.

With the scores ``S_g``, the sums of ``x e`` over a cluster's rows, neither the
sandwich nor the bootstrap needs the rows again: a draw moves the coefficients
by ``A sum_g w_g S_g``, with ``A`` the inverse of the information matrix. So
rows are aggregated to one row for each cluster, which the bootstrap stores,
and what comes to the driver is a matrix of ``p x p``, or of draws by ``p``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import linalg, rng
from lodestar.plans.moments import Design
from lodestar.plans.stored import Scratch, numbered, ranges

#: Leverage from which HC3 is refused.
MOST_LEVERAGE = 0.99
#: Clusters below which a bootstrap is advised.
FEW_CLUSTERS = 42
METHODS = ("rademacher", "webb", "webb_published")
INVALID = "Standard error computation produced invalid values"


@dataclass
class Request:
    """Checked arguments of a regression."""

    x_cols: list[str]
    y_col: str
    include_intercept: bool
    cluster: str | None
    bootstrap: bool
    iterations: int
    seed: int | None
    method: str
    warnings: list[str] = field(default_factory=list)

    def warn(self, text: str) -> None:
        self.warnings.append(text)
        warnings.warn(text, UserWarning, stacklevel=4)


def request(df: DataFrame, x_cols, y_col, include_intercept, cluster, bootstrap, bootstrap_iterations, seed, bootstrap_method) -> Request:
    """Check arguments in a fixed order, so that of several faults the same one is told each time."""
    names = [x_cols] if isinstance(x_cols, str) else list(x_cols)
    method = bootstrap_method.lower()
    if not names:
        raise ValueError("x_cols must contain at least one column name")
    if bootstrap and cluster is None:
        raise ValueError("bootstrap=True requires cluster to be specified")
    if bootstrap_iterations < 1:
        raise ValueError("bootstrap_iterations must be at least 1")
    if method not in METHODS:
        raise ValueError(f"bootstrap_method must be 'rademacher' or 'webb', got: '{bootstrap_method}'")
    if method != "rademacher" and not bootstrap:
        raise ValueError("bootstrap_method requires bootstrap=True")
    for c in [*names, y_col] + ([cluster] if cluster is not None else []):
        if any(ord(x) < 0x20 or ord(x) == 0x7F for x in c):
            raise ValueError(f"Column name '{c}' contains invalid characters")
    for c in [y_col, *names] + ([cluster] if cluster is not None else []):
        if c not in df.columns:
            raise ValueError(f"Column '{c}' not found in DataFrame")
        if c != cluster and not isinstance(df.schema[c].dataType, T.NumericType | T.NullType):
            raise ValueError(f"Column '{c}' must be numeric, not {df.schema[c].dataType.simpleString()}")
    found = Request(names, y_col, include_intercept, cluster, bootstrap, bootstrap_iterations, seed, method)
    if cluster is not None:
        kind = df.schema[cluster].dataType
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.BinaryType):
            raise ValueError(f"Cluster column '{cluster}' has unsupported dtype {kind.simpleString()}")
        if isinstance(kind, T.FloatType | T.DoubleType):
            found.warn(f"Cluster column '{cluster}' is float; will be cast to string for grouping.")
    return found


def scores(design: Design, residual: str) -> DataFrame:
    """``g, n, squares, s0, s1, ...``: rows, squared residuals and scores of each cluster."""
    return design.rows.groupBy("g").agg(F.count("*").alias("n"), F.expr(f"sum({residual} * {residual})").alias("squares"), *[F.expr(f"sum({t} * {residual})").alias(f"s{k}") for k, t in enumerate(design.terms)])


@dataclass(frozen=True)
class Clusters:
    """What the driver has to know of the clusters: how many, the smallest and largest, all squared residuals, and the matrix ``sum S S'``."""

    count: int
    smallest: int
    largest: int
    largest_name: object
    nulls: int
    squares: float
    outer: np.ndarray


def summary(table: DataFrame, p: int) -> Clusters:
    cells = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"o{i}_{j}") for i in range(p) for j in range(i, p)]
    row = table.agg(F.count("*").alias("count"), F.min("n").alias("low"), F.max("n").alias("high"), F.max_by(F.col("g"), F.col("n")).alias("name"), F.count_if(F.col("g").isNull()).alias("nulls"), F.sum("squares").alias("squares"), *cells).first()
    outer = linalg.unpacked([np.nan if row[f"o{i}_{j}"] is None else row[f"o{i}_{j}"] for i in range(p) for j in range(i, p)], p)
    return Clusters(row["count"], row["low"] or 0, row["high"] or 0, row["name"], row["nulls"], np.nan if row["squares"] is None else row["squares"], outer)


def draws(table: DataFrame, p: int, clusters: int, method: str, seed: int, iterations: int) -> np.ndarray:
    """``sum_g w_g S_g`` for each draw of weights: an array of iterations by ``p``.

    ``table`` has the scores and the ``position`` of each cluster in ascending
    order; the weight of cluster ``g`` in draw ``b`` is draw ``b G + g`` of the
    generator. Each task adds up its clusters' part of all draws, so the table
    of clusters never comes together.
    """
    numbered = table.select(F.col("position").alias("k"), *[f"s{j}" for j in range(p)])

    def run(batches):
        total = np.zeros((iterations, p))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                k = part.column(0).to_numpy()
                s = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                for first in range(0, iterations, 1024):
                    draw = np.arange(first, min(first + 1024, iterations))[:, None]
                    total[draw[:, 0]] += rng.weights(method, seed, draw.astype(np.uint64) * np.uint64(clusters) + k.astype(np.uint64)) @ s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), *(pa.array(total[:, j]) for j in range(p))], names=["b", *(f"s{j}" for j in range(p))])

    kind = "b bigint, " + ", ".join(f"s{j} double" for j in range(p))
    summed = numbered.mapInArrow(run, kind).groupBy("b").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(p)])
    out = np.zeros((iterations, p))
    for row in summed.collect():
        out[row[0]] = row[1:]
    return out


def clustered(ask: Request, design: Design, residual: str, bread: np.ndarray, n: int) -> tuple[np.ndarray, Clusters, str]:
    """Standard errors from cluster scores, analytical or by bootstrap; the kind of them."""
    table = scores(design, residual)
    if ask.bootstrap:
        with Scratch(table.sparkSession, "scores") as scratch:
            stored = ranges(table, [F.col("g")], scratch, "scores")
            found = _enough(ask, summary(stored, design.size))
            moved = draws(numbered(stored), design.size, found.count, ask.method, rng.seed_or_clock(ask.seed), ask.iterations) @ bread
        errors = moved.std(axis=0, ddof=1) if ask.iterations > 1 else np.zeros(design.size)
        return _valid(errors), found, f"bootstrap_{ask.method}"
    found = _enough(ask, summary(table, design.size))
    if found.smallest == 1:
        raise ValueError("Cluster contains only 1 observation; clustered standard errors need at least 2 in each, or bootstrap=True")
    if n == design.size:
        raise ValueError(f"{INVALID}; as many parameters as observations")
    c = found.count / (found.count - 1) * (n - 1) / (n - design.size)
    cov = c * bread @ found.outer @ bread
    if linalg.ill_conditioned(cov):
        raise ValueError("Cluster covariance matrix is nearly singular (condition number > 1e10); consider bootstrap=True")
    return _valid(np.sqrt(np.diag(cov))), found, "analytical"


def _enough(ask: Request, found: Clusters) -> Clusters:
    if found.nulls:
        raise ValueError(f"Cluster column '{ask.cluster}' contains null values")
    if found.count < 2:
        raise ValueError(f"Clustered standard errors require at least 2 clusters; found {found.count}")
    return found


def _valid(errors: np.ndarray) -> np.ndarray:
    if not np.isfinite(errors).all():
        raise ValueError(f"{INVALID}; check for extreme values")
    return errors


def advise(ask: Request, found: Clusters, name: str) -> None:
    if not ask.bootstrap and found.count < FEW_CLUSTERS:
        ask.warn(f"Only {found.count} clusters detected. {name} bootstrap (bootstrap=True) is recommended when clusters < {FEW_CLUSTERS}.")


def sandwich_errors(bread: np.ndarray, meat: np.ndarray) -> np.ndarray:
    return _valid(np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0.0)))
