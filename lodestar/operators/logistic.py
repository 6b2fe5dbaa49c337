"""Logistic regression by Newton's method, with HC3, cluster-robust or score-bootstrap standard errors.

Each evaluation is one pass over the cached rows, which gives log-likelihood,
gradient and information matrix together: an accepted step's evaluation is what
the next step starts from.

Sums of many rows carry rounding errors that fixed limits on the gradient and
the likelihood fall below, so steps also end by their length in standard errors,
and a likelihood that is lower by less than such errors doesn't halve a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import linalg
from lodestar.operators import inference
from lodestar.operators.linear import WEIGHT
from lodestar.operators.results import LogisticRegressionResult
from lodestar.plans.moments import Design, double

# Fixed values of the iteration.
MOST_ITERATIONS, HALVINGS = 35, 10
GRADIENT, STALLED, SLACK = 1e-8, 1e-6, 1e-8
FLOOR, CLIP = 1e-10, 1e-15
MOST_COEFFICIENT, EXTREME = 20.0, 1e-7
#: Share of the likelihood that rounding can move: up to half a unit in the last place for each row that a task adds.
ROUNDING = 1e-9
#: Squared length of a step in standard errors that is none, and the one from which a step that doesn't halve it finds rounding errors only.
SHORT, NEAR = 1e-18, 1e-10
#: Change of a row's log-odds above which no step is too short: rows that part the outcomes drift on with little weight.
STILL = 1e-6


@dataclass(frozen=True)
class State:
    """The sums of one pass at ``beta``."""

    beta: np.ndarray
    likelihood: float
    gradient: np.ndarray
    information: np.ndarray
    separated: bool


def probability(eta: Column) -> Column:
    """The logistic function without overflow."""
    small = F.exp(-F.abs(eta))
    return F.when(eta >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def _probability_sql(eta: str) -> str:
    small = f"exp(-abs({eta}))"
    return f"(case when {eta} >= 0 then 1 / (1 + {small}) else {small} / (1 + {small}) end)"


def _numpy_probability(eta: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(eta))
    return np.where(eta >= 0, 1 / (1 + small), small / (1 + small))


def no_worse(found: float, before: float) -> bool:
    """Whether a step to likelihood ``found`` is taken; never for NaN."""
    return found >= before - SLACK - ROUNDING * abs(before)


def settled(gradient: np.ndarray, direction: np.ndarray, reach: np.ndarray, before: float) -> bool:
    """Whether Newton's next step is too short to matter.

    Its squared length in standard errors is ``g'H^-1 g``; ``before`` is that of
    the last step if it was a whole one, else infinite. ``reach`` has the largest
    absolute value of each column of the design.
    """
    length = float(gradient @ direction)
    return bool(np.abs(direction) @ reach <= STILL) and (length <= SHORT or before <= NEAR and length > before / 2)


def _evaluate(design: Design, beta: np.ndarray) -> State:
    p = design.size
    if design.native:
        rows = design.rows.selectExpr("*", f"{design.along(beta)} as eta").selectExpr("*", f"{_probability_sql('eta')} as p")
        sure = f"least(greatest(p, {double(CLIP)}), {double(1 - CLIP)})"
        likelihood = f"sum(y * ln({sure}) + (1 - y) * ln(1 - {sure}))"
        inside = f"count_if(p > {double(EXTREME)} and p < {double(1 - EXTREME)})"
        weight = f"greatest(p * (1 - p), {double(FLOOR)})"
        row = design.collect([likelihood, inside, *[f"sum({t} * (y - p))" for t in design.terms], *design.products(weight)], rows)
        return State(beta, row[0], np.array(row[2 : 2 + p]), linalg.unpacked(row[2 + p :], p), row[1] == 0)

    def block(x, y_):
        pi = _numpy_probability(x @ beta)
        sure = np.clip(pi, CLIP, 1 - CLIP)
        weight = np.maximum(pi * (1 - pi), FLOOR)
        likelihood = (y_ * np.log(sure) + (1 - y_) * np.log(1 - sure)).sum()
        inside = ((pi > EXTREME) & (pi < 1 - EXTREME)).sum()
        return np.concatenate([[likelihood, inside], x.T @ (y_ - pi), linalg.packed((x * weight[:, None]).T @ x)]), np.zeros(0)

    sums, _ = design.blocks(block, 2 + p + p * (p + 1) // 2, 0)
    return State(beta, sums[0], sums[2 : 2 + p], linalg.unpacked(sums[2 + p :], p), sums[1] == 0)


def _maximise(design: Design, reach: np.ndarray) -> tuple[State, int, np.ndarray]:
    """The maximum, the gradients that it took and the inverse information."""
    state, before = _evaluate(design, np.zeros(design.size)), np.inf
    for count in range(1, MOST_ITERATIONS + 1):
        if np.abs(state.beta).max() > MOST_COEFFICIENT or state.separated:
            raise ValueError("Perfect separation detected; the maximum likelihood estimate does not exist")
        if not np.isfinite(state.gradient).all():
            raise ValueError(linalg.UNSTABLE)
        steepness = float(np.linalg.norm(state.gradient))
        singular = "Hessian matrix is singular; check for collinearity"
        if steepness < GRADIENT:
            return state, count, linalg.inverse(state.information, singular)
        if linalg.ill_conditioned(state.information):
            raise ValueError(singular)
        bread = linalg.inverse(state.information, singular)
        direction = bread @ state.gradient
        if settled(state.gradient, direction, reach, before):
            return state, count, bread
        following, half = _step(design, state, direction)
        if following is None:
            if steepness < STALLED:
                return state, count, bread
            raise ValueError(f"Convergence failed after {count} iterations")
        state, before = following, np.inf if half else float(state.gradient @ direction)
    raise ValueError(f"Convergence failed after {MOST_ITERATIONS} iterations")


def _step(design: Design, state: State, direction: np.ndarray) -> tuple[State | None, int]:
    """The first of the halved steps that doesn't lower the likelihood, or the last that has one; and how often it was halved."""
    for half in range(HALVINGS):
        found = _evaluate(design, state.beta + 0.5**half * direction)
        if no_worse(found.likelihood, state.likelihood) or half == HALVINGS - 1 and not np.isnan(found.likelihood):
            return found, half
    return None, HALVINGS


def null_likelihood(n: int, ones: float) -> float:
    share = min(max(ones / n, CLIP), 1 - CLIP)
    return ones * np.log(share) + (n - ones) * np.log(1 - share)


def logistic_regression(
    df: DataFrame, x_cols: str | list[str], y_col: str, include_intercept: bool = True, cluster: str | None = None, bootstrap: bool = False, bootstrap_iterations: int = 1000, seed: int | None = None, bootstrap_method: str = "rademacher"
) -> LogisticRegressionResult:
    """Regress the log-odds of ``y_col`` (0 or 1) on ``x_cols``; standard errors as in ``linear_regression``, the bootstrap being of scores."""
    ask = inference.request(df, x_cols, y_col, include_intercept, cluster, bootstrap, bootstrap_iterations, seed, bootstrap_method)
    design = Design(df, ask.x_cols, y_col, include_intercept, cluster)
    design.rows = design.rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, ones, stray, *reach = design.collect(["count(*)", "sum(y)", "count_if(y not in (0D, 1D))", *[f"max(abs({t}))" for t in design.terms]])
        n = int(n)
        if n == 0:
            raise ValueError("Cannot perform regression on empty data")
        if stray:
            raise ValueError("y_col must contain only 0 and 1 values")
        if ones in (0, n):
            raise ValueError("y_col must contain both 0 and 1 values")
        state, count, bread = _maximise(design, np.array(reach))
        found, kind = None, None
        if cluster is None:
            errors = _hc3(design, state.beta, bread)
        else:
            residual = f"(y - {_probability_sql(design.along(state.beta))})"
            errors, found, kind = inference.clustered(ask, design, residual, bread, n)
            inference.advise(ask, found, "Score")
    finally:
        design.rows.unpersist()
    k, null = int(include_intercept), null_likelihood(n, ones)
    return LogisticRegressionResult(
        state.beta[k:].tolist(),
        float(state.beta[0]) if k else None,
        errors[k:].tolist(),
        float(errors[0]) if k else None,
        n,
        True,
        count,
        float(state.likelihood),
        float(1 - state.likelihood / null) if null else 0.0,
        found.count if found else None,
        kind,
        bootstrap_iterations if bootstrap else None,
        ask.warnings,
    )


def _hc3(design: Design, beta: np.ndarray, bread: np.ndarray) -> np.ndarray:
    p = design.size
    if design.native:
        rows = design.rows.selectExpr("*", f"{design.along(beta)} as eta").selectExpr("*", f"{_probability_sql('eta')} as p")
        rows = rows.selectExpr("*", "y - p as e", f"p * (1 - p) * {design.form(bread)} as h")
        row = design.collect(["max(h)", *design.products(WEIGHT)], rows)
        most, meat = row[0], row[1:]
    else:

        def block(x, y):
            pi = _numpy_probability(x @ beta)
            h = pi * (1 - pi) * np.einsum("ij,jk,ik->i", x, bread, x, optimize=True)
            over = h >= inference.MOST_LEVERAGE
            w = np.where(over, 0.0, ((y - pi) / np.where(over, 1.0, 1 - h)) ** 2)
            return linalg.packed((x * w[:, None]).T @ x), np.array([h.max()])

        meat, (most,) = design.blocks(block, p * (p + 1) // 2, 1)
    if most >= inference.MOST_LEVERAGE:
        raise ValueError("Extreme leverage detected; HC3 standard errors are undefined or unstable")
    return inference.sandwich_errors(bread, linalg.unpacked(meat, p))
