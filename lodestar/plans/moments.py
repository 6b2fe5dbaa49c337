"""Sums over rows that estimators are made of.

Two ways to the same sums. With few columns each entry of a matrix is an
aggregate of its own, and Spark's generated code adds them up in one pass. The
number of entries grows with the square of the columns, and from
``NATIVE_COLUMNS`` on blocks of rows go to NumPy as Arrow batches instead: one
matrix product each. Either way a partition sends one row and only sums reach
the driver.

Expressions are SQL texts: a matrix of them takes one call of the JVM, where
columns take a call for each operator, longer than a small job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the design up to which entries are aggregates of their own.
NATIVE_COLUMNS = 5

NAN = float("nan")


def double(value: float) -> str:
    """A double as SQL, to the last bit."""
    value = float(value)
    return f"({value!r}D)" if np.isfinite(value) else f"double('{value}')"


class Design:
    """Rows of a regression: ``y``, covariates ``x0, x1, ...`` and, if asked for, the cluster ``g``; all numbers are doubles.

    A null number becomes NaN, so that it shows in every sum.
    """

    def __init__(self, df: DataFrame, x_cols: list[str], y_col: str, intercept: bool, cluster: str | None = None):
        number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(NAN))
        columns = [number(y_col).alias("y"), *[number(c).alias(f"x{k}") for k, c in enumerate(x_cols)]]
        if cluster is not None:
            columns.append(F.col(f"`{cluster}`").alias("g"))
        self.rows = df.select(*columns)
        self.covariates = [f"x{k}" for k in range(len(x_cols))]
        self.intercept = intercept
        self.size = len(x_cols) + intercept

    @property
    def terms(self) -> list[str]:
        """The design's columns as SQL, the intercept first."""
        return ["1D"] * self.intercept + self.covariates

    @property
    def native(self) -> bool:
        return self.size <= NATIVE_COLUMNS

    def along(self, beta: np.ndarray) -> str:
        """The linear predictor."""
        return "(" + " + ".join(f"{double(b)} * {t}" for b, t in zip(beta, self.terms, strict=True)) + ")"

    def form(self, matrix: np.ndarray) -> str:
        """The quadratic form ``x'Mx`` of a symmetric matrix."""
        terms = self.terms
        return "(" + " + ".join(f"{double(matrix[i, j] * (1 if i == j else 2))} * {terms[i]} * {terms[j]}" for i in range(self.size) for j in range(i, self.size)) + ")"

    def products(self, weight: str | None = None) -> list[str]:
        """Sums of the upper triangle of ``x x'``, each row weighted."""
        terms, times = self.terms, "" if weight is None else f" * {weight}"
        return [f"sum({terms[i]} * {terms[j]}{times})" for i in range(self.size) for j in range(i, self.size)]

    def collect(self, sums: list[str], rows: DataFrame | None = None) -> list[float]:
        """Aggregates of all rows, in one job."""
        row = (self.rows if rows is None else rows).selectExpr(*[f"{c} as c{k}" for k, c in enumerate(sums)]).first()
        return [NAN if v is None else float(v) for v in row]

    def blocks(self, block: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], sums: int, maxima: int, rows: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums and maxima of what ``block(X, y)`` gives for each batch of rows."""
        intercept, size = self.intercept, self.size

        def run(batches):
            total, top = np.zeros(sums), np.full(maxima, -np.inf)
            for b in batches:
                m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                x = np.column_stack([np.ones(len(m)), m[:, 1:]]) if intercept else m[:, 1:]
                if len(m):
                    s, t = block(x, m[:, 0])
                    total, top = total + s, np.maximum(top, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums + maxima), pa.int32()), pa.array(np.concatenate([total, top]))], names=["k", "v"])

        source = (self.rows if rows is None else rows).select("y", *[f"x{k}" for k in range(size - intercept)])
        parts = source.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v"), F.max("v")).collect()
        total, top = np.zeros(sums), np.full(maxima, -np.inf)
        for k, s, m in parts:
            if k < sums:
                total[k] = s
            else:
                top[k - sums] = m
        return total, top
