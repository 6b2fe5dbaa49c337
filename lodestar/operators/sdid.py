"""Synthetic difference-in-differences: unit and time weights, effect and placebo standard error."""

from __future__ import annotations

import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.functions import rng
from lodestar.functions.simplex import Solution, frank_wolfe
from lodestar.operators.results import SyntheticDIDResult
from lodestar.plans import panel as panels
from lodestar.plans.tall import TOGETHER, Problem, TallPanel, minimise

# Fixed values of the solver.
MOST_STEPS, TOLERANCE = 200, 1e-3
CONCENTRATED, FEW_DRAWS = 0.5, 100


def solve(y: np.ndarray, control: np.ndarray, treated: np.ndarray, pre: np.ndarray, post: np.ndarray) -> tuple[float, Solution, Solution]:
    """The effect and the weights of units and of periods, from a matrix of outcomes and lists of its rows and columns."""
    before, after = y[np.ix_(control, pre)], y[np.ix_(control, post)]
    treated_pre = y[np.ix_(treated, pre)].mean(axis=0)
    spread = before.std(ddof=1) if before.size > 1 else 0.0
    late = after.mean(axis=1)
    units = frank_wolfe(before @ before.T, before @ treated_pre, len(control) ** 0.25 * spread, treated_pre @ treated_pre, MOST_STEPS, TOLERANCE)
    times = frank_wolfe(before.T @ before, before.T @ late, len(pre) ** 0.25 * spread, late @ late, MOST_STEPS, TOLERANCE)
    effect = y[np.ix_(treated, post)].mean() - units.weights @ late - times.weights @ (treated_pre - units.weights @ before)
    return float(effect), units, times


def placebo_units(seed: int, iterations: int, controls: int) -> np.ndarray:
    """The place of the control unit of each iteration: the first draw of a generator of its own, modulo their number."""
    seeds = np.array([(seed + k) % (1 << 64) for k in range(iterations)], dtype=np.uint64)
    return (rng.draws(seeds, np.zeros(iterations, dtype=np.uint64)) % np.uint64(controls)).astype(np.int64)


def placebo_effects(spark: SparkSession, found: panels.Panel, places: list[int], pure: bool = False) -> dict[int, float]:
    """The effect with each of the given control units as treated; a task for a few units each, the panel is broadcast.

    The unit is taken from the controls and added to the treated ones, or with
    ``pure`` put in their place.
    """
    shared = spark.sparkContext.broadcast((found.outcomes, found.control, found.treated, found.pre, found.post))

    def run(batches):
        y, control, treated, pre, post = shared.value
        for b in batches:
            at = b.column(0).to_numpy()
            effects = []
            for k in at.tolist():
                own = control[k : k + 1] if pure else np.concatenate([treated, control[k : k + 1]])
                effects.append(solve(y, np.delete(control, k), own, pre, post)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(effects, pa.float64())], names=["place", "effect"])

    tasks = max(1, min(len(places), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(int(k),) for k in places], "place bigint").repartition(tasks)
    return {r["place"]: r["effect"] for r in rows.mapInArrow(run, "place bigint, effect double").collect()}


def solve_tall(found: TallPanel, places: list[int], pure: bool = False) -> tuple[float, Solution, Solution, np.ndarray, dict[int, float]]:
    """Like ``solve`` on a panel that stays distributed, with the treated units' distance from their controls before treatment and the effects of placebos."""
    controls, treated, pre = len(found.control), len(found.treated), len(found.pre)
    sums, squares = found.products(), found.squares()
    shared = found.rows.sparkSession.sparkContext.broadcast(sums)

    def spread(row: np.ndarray | None) -> float:
        """The standard deviation of the controls' outcomes before treatment, without one of them."""
        n, total, rest = controls * pre, sums[-1, :pre].sum(), squares
        if row is not None:
            m = row[:pre].mean()
            apart = m - (total - row[:pre].sum()) / (n - pre)
            rest -= ((row[:pre] - m) ** 2).sum() + apart**2 * pre * (n - pre) / n
            n -= pre
        return float(np.sqrt(max(rest, 0.0) / (n - 1))) if n > 1 else 0.0

    def times(sums: np.ndarray, row: np.ndarray, ridge: float) -> Solution:
        own = sums[: pre + 1, : pre + 1] - np.outer(row, row)
        return frank_wolfe(own[:pre, :pre], own[:pre, pre], ridge, own[pre, pre], MOST_STEPS, TOLERANCE)

    def effect(p: Problem, weights: np.ndarray) -> float:
        return float(p.target[-1] - p.mean[-1] - weights @ (p.target[:-1] - p.mean[:-1]))

    def run(batches):
        for b in batches:
            solved = [times(shared.value, np.array(row), ridge).weights for row, ridge in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(solved, pa.list_(pa.float64()))], names=["place", "weights"])

    own = Problem(found.target, sums[-1, : pre + 1] / controls, controls, controls**0.25 * spread(None))
    spark, effects = found.rows.sparkSession, {}
    for start in range(0, max(len(places), 1), TOGETHER):
        rows = found.of(places[start : start + TOGETHER])
        spreads = {k: spread(row) for k, row in rows.items()}
        problems = {k: Problem(row if pure else (treated * found.target + row) / (treated + 1), (sums[-1, : pre + 1] - row) / (controls - 1), controls - 1, (controls - 1) ** 0.25 * spreads[k], k) for k, row in rows.items()}
        minimise(found, [*([own] if not start else []), *problems.values()], MOST_STEPS, TOLERANCE, constant=True)
        if problems:
            tasks = min(len(problems), spark.sparkContext.defaultParallelism)
            source = spark.createDataFrame([(k, row.tolist(), float(pre**0.25 * spreads[k])) for k, row in rows.items()], "place bigint, row array<double>, ridge double").repartition(tasks)
            for r in source.mapInArrow(run, "place bigint, weights array<double>").collect():
                effects[r["place"]] = effect(problems[r["place"]], np.array(r["weights"]))
    time = times(sums, np.zeros(pre + 1), pre**0.25 * spread(None))
    unit = Solution(own.weights(controls), own.iterations, own.best_gap, own.met)
    return effect(own, time.weights), unit, time, own.target[:-1] - own.mean[:-1], effects


def synthetic_did(df: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, bootstrap_iterations: int = 200, seed: int | None = None, pure_placebo: bool = False) -> SyntheticDIDResult:
    """The average effect on treated units of a balanced panel.

    A unit is treated if it ever is, and a period counts as after treatment if
    any unit is treated in it. Iterations that draw the same control unit give
    the same effect, so each unit is solved for once.
    """
    if bootstrap_iterations < 0:
        panels.check(df, unit_col, time_col, outcome_col, treatment_col, "SDID")
        raise ValueError("bootstrap_iterations must be at least 0")
    found = panels.detect(df, unit_col, time_col, outcome_col, treatment_col, "SDID")
    controls, pre = len(found.control), len(found.pre)
    if controls < 2:
        raise ValueError(f"At least 2 control units required; found {controls}")
    if not len(found.treated):
        raise ValueError("No treated units found in data")
    if pre < 2:
        raise ValueError(f"At least 2 pre-treatment periods required; found {pre}")
    if not len(found.post):
        raise ValueError("No post-treatment periods found")
    drawn = Counter(placebo_units(rng.seed_or_clock(seed), bootstrap_iterations, controls).tolist()) if bootstrap_iterations else Counter()
    if isinstance(found, TallPanel):
        try:
            effect, units, times, gap, effects = solve_tall(found, sorted(drawn), pure_placebo)
        finally:
            found.drop()
    else:
        effect, units, times = solve(found.outcomes, found.control, found.treated, found.pre, found.post)
        gap = found.part(found.treated, found.pre).mean(axis=0) - units.weights @ found.part(found.control, found.pre)
        effects = placebo_effects(df.sparkSession, found, sorted(drawn), pure_placebo) if drawn else {}
    error, used = _placebo_error(effects, drawn) if drawn else (0.0, 0)
    notes = []
    for name, of, weights in (("Unit", "control unit", units.weights), ("Time", "pre-period", times.weights)):
        if weights.max() > CONCENTRATED:
            notes.append(f"{name} weight concentration: {of} at index {int(weights.argmax())} has weight {weights.max():.2%}. Results may be sensitive to it.")
    if bootstrap_iterations < FEW_DRAWS:
        notes.append(f"bootstrap_iterations={bootstrap_iterations} is less than {FEW_DRAWS}. Standard error estimates may be unreliable.")
    for note in notes:
        warnings.warn(note, UserWarning, stacklevel=2)
    return SyntheticDIDResult(
        effect, error, units.weights.tolist(), times.weights.tolist(), controls, len(found.treated), pre, len(found.post), (MOST_STEPS, MOST_STEPS), True, float(np.sqrt((gap @ gap) / pre)), used,
        (units.iterations, times.iterations), (units.gap, times.gap), notes,
    )


def _placebo_error(effects: dict[int, float], times: Counter) -> tuple[float, int]:
    iterations = times.total()
    good = [(e, times[k]) for k, e in effects.items() if np.isfinite(e)]
    used = sum(n for _, n in good)
    if iterations - used > iterations / 2:
        raise ValueError(f"More than 50% of placebo bootstrap iterations failed ({iterations - used}/{iterations})")
    if used < 2:
        return 0.0, used
    values, counts = np.array([e for e, _ in good]), np.array([n for _, n in good])
    mean = (values * counts).sum() / used
    return float(np.sqrt((counts * (values - mean) ** 2).sum() / (used - 1))), used
