"""Synthetic control in four variants, with in-space placebo standard errors."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.simplex import frank_wolfe, project, solved
from lodestar.operators.results import SyntheticControlResult
from lodestar.plans import panel as panels
from lodestar.plans.tall import TOGETHER, Problem, TallPanel, minimise

METHODS = ("traditional", "penalized", "robust", "augmented")
# The penalties that are tried, and those used where none is given.
PENALTIES = tuple(10.0**k for k in range(-4, 5))
PENALTY, RIDGE = 1.0, 1.0
CONCENTRATED, POOR_FIT = 0.5, 0.1


@dataclass(frozen=True)
class View:
    """Outcomes of the controls and of the one treated unit, before and after treatment."""

    control_pre: np.ndarray
    control_post: np.ndarray
    treated_pre: np.ndarray
    treated_post: np.ndarray

    def effect(self, w: np.ndarray) -> float:
        return float((self.treated_post - w @ self.control_post).mean())

    def fit(self, w: np.ndarray) -> float:
        """Mean squared difference before treatment."""
        return float(((self.treated_pre - w @ self.control_pre) ** 2).mean())


def view(y: np.ndarray, control: np.ndarray, treated: int, pre: np.ndarray, post: np.ndarray) -> View:
    return View(y[np.ix_(control, pre)], y[np.ix_(control, post)], y[treated, pre], y[treated, post])


def _least_squares(control: np.ndarray, treated: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    return frank_wolfe(control @ control.T, control @ treated, max_iter=max_iter, tol=tol).weights


def _penalized(v: View, penalty: float) -> np.ndarray:
    """The ridge solution without constraints, projected onto the simplex."""
    gram = v.control_pre @ v.control_pre.T
    return project(solved(gram + penalty * np.eye(len(gram)), v.control_pre @ v.treated_pre))


def selected_penalty(v: View) -> float:
    """The penalty with the best fit before treatment, the smaller of equals; ``PENALTY`` if none can be solved."""
    best, chosen = np.inf, PENALTY
    for penalty in PENALTIES:
        try:
            loss = v.fit(_penalized(v, penalty)) * len(v.treated_pre)
        except ValueError:
            continue
        if loss < best:
            best, chosen = loss, penalty
    return chosen


def weights(v: View, method: str, penalty: float | None, max_iter: int, tol: float) -> np.ndarray:
    """Weights of the controls; the augmented method has those of the traditional one."""
    if method == "penalized":
        return _penalized(v, PENALTY if penalty is None else penalty)
    if method == "robust":
        return _least_squares(v.control_pre - v.control_pre.mean(axis=1, keepdims=True), v.treated_pre - v.treated_pre.mean(), max_iter, tol)
    return _least_squares(v.control_pre, v.treated_pre, max_iter, tol)


def bias(v: View, w: np.ndarray, ridge: float) -> float:
    """What a ridge regression of late on early outcomes predicts for the weighted controls beyond the treated unit."""
    x = v.control_pre
    slopes = solved(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ v.control_post.mean(axis=1))
    return float(w @ (x @ slopes) - v.treated_pre @ slopes)


def placebo_effects(spark: SparkSession, found: panels.Panel, method: str, penalty: float | None, max_iter: int, tol: float, count: int) -> list[float]:
    """Effects with each of the first ``count`` controls in the treated unit's place; those that can't be computed are left out."""
    shared = spark.sparkContext.broadcast((found.outcomes, found.control, found.pre, found.post))

    def run(batches):
        y, control, pre, post = shared.value
        for b in batches:
            places, effects = [], []
            for k in b.column(0).to_pylist():
                others = np.delete(control, k)
                if not len(others):
                    continue
                v = view(y, others, control[k], pre, post)
                try:
                    effect = v.effect(weights(v, method, penalty, max_iter, tol))
                except ValueError:
                    continue
                if np.isfinite(effect):
                    places.append(k)
                    effects.append(effect)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(effects, pa.float64())], names=["place", "effect"])

    tasks = max(1, min(count, spark.sparkContext.defaultParallelism))
    rows = spark.range(count, numPartitions=tasks).mapInArrow(run, "place bigint, effect double").collect()
    return [r["effect"] for r in sorted(rows)]


def solve_tall(found: TallPanel, method: str, ridge: float, max_iter: int, tol: float, count: int) -> tuple[np.ndarray, float, float, list[float]]:
    """Weights, effect, mean squared difference before treatment and effects of ``count`` placebos, from a panel that stays distributed."""
    controls, pre = len(found.control), len(found.pre)
    sums = found.products()
    total = sums[-1, : pre + 1]
    own, effects = Problem(found.target, total / controls, controls), []
    for start in range(0, max(count, 1), TOGETHER):
        rows = found.of(list(range(start, min(start + TOGETHER, count)))) if controls > 1 else {}
        placebos = [Problem(row, (total - row) / (controls - 1), controls - 1, without=k) for k, row in sorted(rows.items())]
        minimise(found, [*([own] if not start else []), *placebos], max_iter, tol, centred=method == "robust")
        effects += [float(p.target[-1] - p.mean[-1]) for p in placebos]
    effect, apart = float(own.target[-1] - own.mean[-1]), own.target[:-1] - own.mean[:-1]
    if method == "augmented":
        effect += float(apart @ solved(sums[:pre, :pre] + ridge * np.eye(pre), sums[:pre, pre]))
    return own.weights(controls), effect, float((apart**2).mean()), [e for e in effects if np.isfinite(e)]


def synthetic_control(
    df: DataFrame, unit_col: str, time_col: str, outcome_col: str, treatment_col: str, method: str = "traditional", lambda_param: float | None = None, compute_se: bool = True, n_placebo: int | None = None, max_iter: int = 1000, tol: float = 1e-6, seed: int | None = None
) -> SyntheticControlResult:
    """The effect on the one treated unit of a balanced panel, against a weighted mean of controls.

    ``seed`` is accepted for symmetry: the placebo test takes controls in order
    and draws nothing.
    """
    kind = method.lower()
    if kind not in METHODS or lambda_param is not None and lambda_param < 0:
        panels.check(df, unit_col, time_col, outcome_col, treatment_col, "SC")
        if kind not in METHODS:
            raise ValueError(f"method must be one of {set(METHODS)}, got '{method}'")
        raise ValueError(f"lambda_param must be >= 0, got {lambda_param}")
    found = panels.detect(df, unit_col, time_col, outcome_col, treatment_col, "SC")
    _sizes(found, kind)
    controls, pre = len(found.control), len(found.pre)
    penalty, ridge = lambda_param, RIDGE if lambda_param is None else lambda_param
    count = 0 if not compute_se else controls if n_placebo is None else min(n_placebo, controls)
    if isinstance(found, TallPanel):
        try:
            if kind == "penalized":
                raise ValueError(f"method 'penalized' takes panels of at most {panels.MOST_CELLS} cells")
            w, effect, mse, effects = solve_tall(found, kind, ridge, max_iter, tol, count)
        finally:
            found.drop()
    else:
        v = view(found.outcomes, found.control, int(found.treated[0]), found.pre, found.post)
        penalty = selected_penalty(v) if kind == "penalized" and lambda_param is None else lambda_param
        w = weights(v, kind, penalty, max_iter, tol)
        effect, mse = v.effect(w), v.fit(w)
        if kind == "augmented":
            effect -= bias(v, w, ridge)
        effects = placebo_effects(df.sparkSession, found, kind, lambda_param, max_iter, tol, count) if count else []
    error, used, failed = None, None, None
    if len(effects) >= 2:
        error, used, failed = float(np.std(effects, ddof=1)), len(effects), count - len(effects)
    notes = []
    if w.max() > CONCENTRATED:
        notes.append(f"Unit weight concentration: control unit at index {int(w.argmax())} has weight {w.max():.2%}. Results may be sensitive to it.")
    if found.spread > 0 and np.sqrt(mse) / found.spread > POOR_FIT:
        notes.append(f"Pre-treatment RMSE ({np.sqrt(mse):.4f}) is {np.sqrt(mse) / found.spread:.1%} of outcome std ({found.spread:.4f}). Consider another method or check the data.")
    for note in notes:
        warnings.warn(note, UserWarning, stacklevel=2)
    in_effect = penalty if kind == "penalized" else ridge if kind == "augmented" else None
    return SyntheticControlResult(
        effect, error, w.tolist(), float(np.sqrt(mse)), mse, kind, lambda_param if kind in ("penalized", "augmented") else None, controls, pre, len(found.post), True, max_iter if kind != "penalized" else 1, used, failed, in_effect, notes
    )


def _sizes(found: panels.Panel | TallPanel, kind: str) -> None:
    treated, controls, pre = len(found.treated), len(found.control), len(found.pre)
    if not treated:
        raise ValueError("No treated units found in data")
    if treated > 1:
        raise ValueError(f"Synthetic Control requires exactly 1 treated unit; found {treated}. Use synthetic_did() for several.")
    if not controls:
        raise ValueError(f"At least 1 control unit required; found {controls}")
    if kind == "augmented" and controls < 2:
        raise ValueError(f"Augmented SC requires at least 2 control units; found {controls}")
    if not pre:
        raise ValueError(f"At least 1 pre-treatment period required; found {pre}")
    if kind == "augmented" and pre < 2:
        raise ValueError(f"Augmented SC requires at least 2 pre-treatment periods; found {pre}")
    if not len(found.post):
        raise ValueError("No post-treatment periods found")
