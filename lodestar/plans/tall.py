"""Panels of many units: rows stay distributed, and only what has the size of a few units comes to the driver.

Weights of units are found with the same steps as on a matrix in memory, but a
step needs no more than the control unit with the smallest gradient: one job
looks for it, for all problems (the estimate and its placebos) at once. The
driver holds, for each problem, the weighted mean of the controls and the few
weights that steps have touched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.stored import Scratch, positions

#: Periods beyond which a panel is refused: a task holds a batch of units' rows, and the driver a matrix of periods.
MOST_PERIODS = 4000
#: Problems that step together.
TOGETHER = 200


@dataclass(frozen=True)
class TallPanel:
    """A balanced panel whose units' rows are stored.

    ``rows`` has ``place, row`` of the control units, numbered from 0 in
    ascending order: the outcomes before treatment, then the mean of those
    after it. ``target`` is the mean row of the treated units. The ranges
    stand for the units and periods of each kind.
    """

    rows: DataFrame
    target: np.ndarray
    control: range
    treated: range
    pre: range
    post: range
    spread: float
    scratch: Scratch

    def of(self, places: list[int]) -> dict[int, np.ndarray]:
        """The rows of some controls; as many as the caller has placebos at a time."""
        return {r["place"]: np.array(r["row"]) for r in self.rows.where(F.col("place").isin(places)).collect()} if places else {}

    def products(self) -> np.ndarray:
        """Sums over controls of the products of all columns of their rows and a column of ones."""
        size = len(self.pre) + 2

        def run(batches):
            total = np.zeros((size, size))
            for b in batches:
                x = np.column_stack([_matrix(b.column(0), size - 1), np.ones(b.num_rows)])
                total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(_matrix(c, size).sum(axis=0) for c in table["sums"].chunks)
            return pa.table({"k": table["k"].slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})

        parts = self.rows.select("row").mapInArrow(run, "k bigint, sums array<double>").groupBy("k").applyInArrow(add, "k bigint, sums array<double>").toArrow()
        found = np.zeros((size, size))
        found[parts["k"].to_numpy()] = _matrix(parts["sums"].combine_chunks(), size)
        return found

    def squares(self) -> float:
        """The sum of squared distances of the controls' outcomes before treatment from their mean."""
        cell = F.explode(F.slice("row", 1, len(self.pre))).alias("y")
        n, variance = self.rows.select(cell).agg(F.count("y"), F.var_pop("y")).first()
        return n * variance

    def drop(self) -> None:
        self.scratch.drop()


def tall(cells: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, spread: float) -> TallPanel:
    """The panel of checked, balanced ``cells``."""
    scratch = Scratch(cells.sparkSession, "tall")
    named = cells.select(F.col(f"`{unit_col}`").alias("unit"), F.col(f"`{time_col}`").alias("time"), F.col(f"`{outcome_col}`").cast("double").alias("y"), (F.col(f"`{treatment_col}`").cast("double") > 0).alias("now"))
    # One row for each period, of which there are at most MOST_PERIODS.
    periods = named.groupBy(F.col("time").alias("of_time")).agg(F.max("now").alias("after"))
    known = named.join(F.broadcast(scratch.write(periods, "periods")), F.col("time") == F.col("of_time"))
    early = F.array_sort(F.collect_list(F.when(~F.col("after"), F.struct("time", "y"))))
    late = F.avg(F.when(F.col("after"), F.col("y")))
    grouped = known.groupBy("unit").agg(F.max("now").alias("treated"), F.concat(F.transform(early, lambda c: c["y"]), F.array(late)).alias("row"))
    units = scratch.write(grouped, "units")
    counts = units.agg(F.count_if(~F.col("treated")), F.count_if("treated")).first()
    after = scratch.spark.read.parquet(f"{scratch.path}/periods").agg(F.count_if(~F.col("after")), F.count_if("after")).first()
    placed = positions(units.where(~F.col("treated")).select("unit", "row"), [F.col("unit")], scratch, "ranges")
    rows = scratch.write(placed.select(F.col("position").alias("place"), "row"), "controls")
    means = units.where("treated").select(F.posexplode("row")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()
    target = np.full(after[0] + 1, np.nan)
    for pos, mean in means:
        target[pos] = np.nan if mean is None else mean
    return TallPanel(rows, target, range(counts[0]), range(counts[1]), range(after[0]), range(after[1]), spread, scratch)


@dataclass
class Problem:
    """Weights of controls, all but ``without``, whose mean comes near ``target``; ``mean`` is that of equal weights.

    Rows, means and targets end with the value after treatment, which takes no part in the search.
    """

    target: np.ndarray
    mean: np.ndarray
    units: int
    ridge: float = 0.0
    without: int = -1
    #: The state: equal weights count ``base`` each, besides those that steps touched.
    base: float = 0.0
    touched: dict[int, float] = field(default_factory=dict)
    best: tuple[float, dict[int, float], np.ndarray] | None = None
    best_value: float = np.inf
    best_gap: float = np.inf
    iterations: int = 0
    met: bool = False

    def weights(self, controls: int) -> np.ndarray:
        """Weights of all controls, 0 for the one left out."""
        w = np.full(controls, self.base)
        if self.without >= 0:
            w[self.without] = 0.0
        for place, more in self.touched.items():
            w[place] += more
        return w

    def length(self) -> float:
        """The squared length of the weights."""
        own = np.array(list(self.touched.values()))
        return float(self.units * self.base**2 + 2 * self.base * own.sum() + own @ own)


def minimise(panel: TallPanel, problems: list[Problem], max_iter: int, tol: float, centred: bool = False, constant: bool = False) -> None:
    """Solve all problems by the steps of ``simplex.frank_wolfe``, one job for each step of all of them.

    With ``centred`` rows and targets are taken less their mean over the periods
    before treatment; with ``constant`` the target's squared length is part of the objective.
    Values that aren't numbers leave a problem with means that aren't, either.
    """
    own = lambda x: x[:-1] - x[:-1].mean() if centred else x[:-1]
    for p in problems:
        p.base = 1.0 / p.units
    for k in range(max_iter):
        live = [p for p in problems if not p.met]
        if not live:
            break
        found = _smallest(panel, live, np.array([own(p.mean) - own(p.target) for p in live]))
        for n, p in enumerate(live):
            if n not in found:
                p.mean, p.met = np.full(len(p.mean), np.nan), True
                p.best = None
                continue
            value, place, row = found[n]
            u, a, length = own(p.mean), own(p.target), p.length()
            gap = 2 * float(u @ (u - a) + p.ridge * length - value - p.ridge * p.base)
            if k % 100 == 0 or gap < p.best_gap:
                objective = float(u @ u + p.ridge * length - 2 * (u @ a) + (a @ a if constant else 0.0))
                if objective < p.best_value:
                    p.best, p.best_value, p.best_gap = (p.base, dict(p.touched), p.mean), objective, gap
            if gap / (abs(max(p.best_value, 1.0)) + 1e-10) < tol:
                p.iterations, p.best_gap, p.met = k, gap, True
                continue
            step = 2.0 / (k + 2.0)
            p.base *= 1 - step
            p.touched = {at: w * (1 - step) for at, w in p.touched.items() if w * (1 - step)}
            p.touched[place] = p.touched.get(place, 0.0) + step
            p.mean = (1 - step) * p.mean + step * row
    for p in problems:
        if not p.met:
            p.iterations = max_iter
            if p.best is not None:
                p.base, p.touched, p.mean = p.best


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _smallest(panel: TallPanel, problems: list[Problem], directions: np.ndarray) -> dict[int, tuple[float, int, np.ndarray]]:
    """For each problem the control with the smallest product of its row and the direction, plus the ridge times its touched weight; the first of equals."""
    entries = [(at, n, p.ridge * w) for n, p in enumerate(problems) for at, w in p.touched.items()]
    entries += [(p.without, n, np.inf) for n, p in enumerate(problems) if p.without >= 0]
    places, of, more = (np.array([e[c] for e in entries], kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))
    shared = panel.rows.sparkSession.sparkContext.broadcast((directions, places, of, more))

    def run(batches):
        directions, places, of, more = shared.value
        count, width = directions.shape
        values, best, rows = np.full(count, np.inf), np.zeros(count, np.int64), np.zeros((count, width + 1))
        for b in batches:
            if not b.num_rows:
                continue
            at, m = b.column(0).to_numpy(), _matrix(b.column(1), width + 1)
            products = m[:, :-1] @ directions.T
            if len(places):
                order = np.argsort(at)
                spot = order[np.minimum(np.searchsorted(at, places, sorter=order), len(at) - 1)]
                here = at[spot] == places
                products[spot[here], of[here]] += more[here]
            first = products.argmin(axis=0)
            smallest = products[first, np.arange(count)]
            better = (smallest < values) | (smallest == values) & np.isfinite(smallest) & (at[first] < best)
            values[better], best[better], rows[better] = smallest[better], at[first][better], m[first][better]
        got = np.flatnonzero(np.isfinite(values))
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(values[got]), pa.array(best[got]), pa.array(list(rows[got]), pa.list_(pa.float64()))], names=["problem", "value", "place", "row"])

    each = panel.rows.mapInArrow(run, "problem bigint, value double, place bigint, row array<double>")
    found = each.groupBy("problem").agg(F.min(F.struct("value", "place", "row")).alias("m")).collect()
    shared.destroy()
    return {r["problem"]: (r["m"]["value"], r["m"]["place"], np.array(r["m"]["row"])) for r in found}
