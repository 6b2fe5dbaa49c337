"""Balanced panels: validation, who is treated when, and the matrix of outcomes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.plans.stored import Scratch
from lodestar.plans.tall import MOST_PERIODS, TallPanel, tall

#: Cells of a panel beyond which it isn't brought to the driver: 400 MB of doubles.
MOST_CELLS = 50_000_000


@dataclass(frozen=True)
class Panel:
    """Outcomes of units (rows) and periods (columns), both in ascending order."""

    outcomes: np.ndarray
    units: list
    periods: list
    control: np.ndarray
    treated: np.ndarray
    pre: np.ndarray
    post: np.ndarray
    spread: float

    def part(self, units: np.ndarray, periods: np.ndarray) -> np.ndarray:
        return self.outcomes[np.ix_(units, periods)]


def check(df: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, method: str) -> dict:
    """Raise ValueError for what isn't a panel; one pass over the rows, whose counts are returned."""
    columns = set(df.columns)
    for c in (unit_col, time_col, outcome_col, treatment_col):
        if c not in columns:
            raise ValueError(f"Column '{c}' not found in DataFrame")
    kind = lambda c: df.schema[c].dataType
    u, t, y, d = (F.col(f"`{c}`") for c in (unit_col, time_col, outcome_col, treatment_col))
    numeric = isinstance(kind(outcome_col), T.NumericType)
    treatable = isinstance(kind(treatment_col), T.NumericType | T.BooleanType)
    stray = F.coalesce(~d.cast("double").isin(0.0, 1.0), F.lit(True)) if treatable else F.lit(True)
    found = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(u).alias("units"),
        F.count_distinct(t).alias("periods"),
        F.count_distinct(u, t).alias("cells"),
        F.count_if(y.isNull()).alias("nulls"),
        F.count_if(u.isNull() | t.isNull()).alias("nameless"),
        F.count_if(stray).alias("stray"),
        (F.stddev_samp(y.cast("double")) if numeric else F.lit(None).cast("double")).alias("spread"),
    ).first()
    if not found["rows"]:
        raise ValueError(f"Cannot perform {method} on empty DataFrame")
    for c, label in ((unit_col, "unit_col"), (time_col, "time_col")):
        if isinstance(kind(c), T.FractionalType):
            raise ValueError(f"{label} must be integer or string, not float")
    if not numeric:
        raise ValueError("outcome_col must be numeric")
    if found["nulls"]:
        raise ValueError(f"outcome_col '{outcome_col}' contains null values")
    if found["stray"]:
        raise ValueError("treatment_col must contain only 0 and 1 values")
    return found.asDict()


def labels(df: DataFrame, key: str, treatment_col: str) -> DataFrame:
    """``key`` and whether any of its rows is treated: of units, who is treated; of periods, which are after treatment."""
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg((F.max(F.col(f"`{treatment_col}`").cast("double")) > 0).alias("treated"))


def cells(df: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, scratch: Scratch) -> DataFrame:
    """The four columns of a panel, stored: a panel is read several times, and is often the result of an aggregate."""
    return scratch.write(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((unit_col, time_col, outcome_col, treatment_col))]), "cells")


def series(df: DataFrame, unit_col: str, time_col: str, outcome_col: str) -> DataFrame:
    """``unit, outcomes``: each unit's outcomes in order of time, as an array."""
    cells = df.select(F.col(f"`{unit_col}`").alias("unit"), F.col(f"`{time_col}`").alias("time"), F.col(f"`{outcome_col}`").cast("double").alias("y"))
    ordered = F.array_sort(F.collect_list(F.struct("time", "y")))
    return cells.groupBy("unit").agg(F.transform(ordered, lambda c: c["y"]).alias("outcomes"))


def gram(df: DataFrame, unit_col: str, time_col: str, outcome_col: str) -> DataFrame:
    """``unit_a, unit_b, product``: sums over time of products of two units' outcomes, each pair once."""
    cells = lambda s: df.select(F.col(f"`{time_col}`").alias("time"), F.col(f"`{unit_col}`").alias(f"unit_{s}"), F.col(f"`{outcome_col}`").cast("double").alias(f"y_{s}"))
    both = cells("a").join(cells("b"), "time").where("unit_a <= unit_b")
    return both.groupBy("unit_a", "unit_b").agg(F.sum(F.col("y_a") * F.col("y_b")).alias("product"))


def detect(df: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, method: str) -> Panel | TallPanel:
    """The panel of ``df``. Stricter than a count of rows: every unit has each period once.

    ``df`` is read once. The outcomes come to the driver as Arrow arrays, a row
    for each unit; what is broadcast of a panel is bounded by ``MOST_CELLS``, too.
    A panel with more cells stays distributed, with up to ``MOST_PERIODS`` periods.
    """
    if not {unit_col, time_col, outcome_col, treatment_col} <= set(df.columns):
        check(df, unit_col, time_col, outcome_col, treatment_col, method)
    with Scratch(df.sparkSession, "panel") as scratch:
        stored = cells(df, unit_col, time_col, outcome_col, treatment_col, scratch)
        found = check(stored, unit_col, time_col, outcome_col, treatment_col, method)
        expected = found["units"] * found["periods"]
        if found["rows"] != expected or found["cells"] != expected or found["nameless"]:
            raise ValueError(f"Panel is not balanced: expected {expected} rows ({found['units']} units × {found['periods']} periods), found {found['rows']}")
        if expected > MOST_CELLS:
            if found["periods"] > MOST_PERIODS:
                raise ValueError(f"The panel has {expected} cells and {found['periods']} periods; panels of more than {MOST_CELLS} cells may have {MOST_PERIODS}")
            return tall(stored, unit_col, time_col, outcome_col, treatment_col, found["spread"] or 0.0)
        whole = series(stored, unit_col, time_col, outcome_col).join(labels(stored, unit_col, treatment_col), F.col("unit") == F.col("key"))
        units = whole.select("unit", "treated", "outcomes").toArrow()
        periods = sorted((r["key"], r["treated"]) for r in labels(stored, time_col, treatment_col).collect())
    names, after = units["unit"].to_pylist(), np.array([p[1] for p in periods])
    order = sorted(range(len(names)), key=names.__getitem__)
    values = units["outcomes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    is_treated = np.array(units["treated"].to_pylist())[order]
    return Panel(
        values.reshape(len(names), len(periods))[order].astype(np.float64),
        [names[k] for k in order],
        [p for p, _ in periods],
        np.flatnonzero(~is_treated),
        np.flatnonzero(is_treated),
        np.flatnonzero(~after),
        np.flatnonzero(after),
        found["spread"] if found["spread"] is not None else 0.0,
    )
