"""Logistic regressions of many groups at once.

All groups take their Newton steps together: a pass over the rows evaluates
every group that is still under way at its own candidate, and a stored table
with one row for each group carries what the iteration has to remember, so that
each step's plan starts there and joins know the table's size. Groups that are
done leave the table, and no group has to fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import linalg
from lodestar.operators import inference
from lodestar.operators import logistic as one
from lodestar.plans.moments import NAN
from lodestar.plans.stored import Scratch

_STATE = "n bigint, ones double, reach array<double>, beta array<double>, likelihood double, gradient array<double>, info array<double>, candidate array<double>, direction array<double>, step double, halvings int, steps bigint, error string"


def _same(names: list[str], other: str) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{other}{n}"))
    return same


def _advance(row: dict, p: int) -> dict:
    """One group's state after its candidate has been evaluated."""
    state = {k: row[k] for k in ("n", "ones", "reach", "beta", "likelihood", "gradient", "info", "candidate", "direction", "step", "halvings", "steps", "error")}
    first, found = state["beta"] is None, row["new_likelihood"]
    if not first and not (one.no_worse(found, state["likelihood"]) or state["halvings"] == one.HALVINGS - 1 and not np.isnan(found)):
        state["halvings"] += 1
        if state["halvings"] >= one.HALVINGS:
            stalled = np.linalg.norm(state["gradient"]) < one.STALLED
            return state | {"direction": None, "error": None if stalled else f"Convergence failed after {state['steps']} iterations"}
        step = state["step"] / 2
        return state | {"step": step, "candidate": (np.array(state["beta"]) + step * np.array(state["direction"])).tolist()}
    before = np.inf if first or state["halvings"] else float(np.dot(state["gradient"], state["direction"]))
    beta, gradient = np.array(state["candidate"]), np.array(row["new_gradient"])
    information = linalg.unpacked(row["new_info"], p)
    state |= {"beta": beta.tolist(), "likelihood": found, "gradient": gradient.tolist(), "info": row["new_info"], "halvings": 0, "step": 1.0, "steps": state["steps"] + 1, "direction": None}
    singular = "Hessian matrix is singular; check for collinearity"
    try:
        if np.abs(beta).max() > one.MOST_COEFFICIENT or row["inside"] == 0:
            raise ValueError("Perfect separation detected; the maximum likelihood estimate does not exist")
        if not np.isfinite(gradient).all():
            raise ValueError(linalg.UNSTABLE)
        if np.linalg.norm(gradient) < one.GRADIENT:
            linalg.inverse(information, singular)
            return state
        if linalg.ill_conditioned(information):
            raise ValueError(singular)
        direction = linalg.inverse(information, singular) @ gradient
        if one.settled(gradient, direction, np.array(state["reach"]), before):
            return state
        if state["steps"] >= one.MOST_ITERATIONS:
            raise ValueError(f"Convergence failed after {one.MOST_ITERATIONS} iterations")
    except ValueError as e:
        return state | {"error": str(e)}
    return state | {"direction": direction.tolist(), "candidate": (beta + direction).tolist()}


def logistic_regression_by(df: DataFrame, keys: str | list[str], x_cols: str | list[str], y_col: str, include_intercept: bool = True) -> DataFrame:
    """A logistic regression with HC3 errors for each group: a row of ``keys``, ``n_samples, coefficients, intercept, standard_errors, intercept_se, iterations, log_likelihood, pseudo_r_squared, error``.

    Where a group can't be fitted ``error`` says why and the estimates are null.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    x_cols = [x_cols] if isinstance(x_cols, str) else list(x_cols)
    names, p = [f"k{n}" for n in range(len(keys))], len(x_cols) + include_intercept
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(NAN))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)], number(y_col).alias("y"), *[number(c).alias(f"x{k}") for k, c in enumerate(x_cols)]).persist()
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    terms = [F.lit(1.0)] * include_intercept + [F.col(f"x{k}") for k in range(len(x_cols))]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    try:
        fault = F.when(F.col("stray") > 0, "y_col must contain only 0 and 1 values").when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), "y_col must contain both 0 and 1 values")
        counted = rows.groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("stray"), F.array(*[F.max(F.abs(t)) for t in terms]).alias("reach"))
        null = lambda kind: F.lit(None).cast(kind)
        zero = F.array_repeat(F.lit(0.0), p)
        start = counted.select(
            *names, "n", "ones", "reach", null("array<double>").alias("beta"), null("double").alias("likelihood"), null("array<double>").alias("gradient"), null("array<double>").alias("info"), zero.alias("candidate"), zero.alias("direction"), F.lit(1.0).alias("step"), F.lit(0).alias("halvings"), F.lit(0).cast("bigint").alias("steps"), fault.alias("error")
        )
        # What has been evaluated is stored, so the table that a step reads stays until the end.
        scratch, step = Scratch(df.sparkSession, "logistic"), 0
        state, done = scratch.write(start, "step0"), []
        while True:
            under_way = F.col("direction").isNotNull() & F.col("error").isNull()
            done.append(state.where(~under_way))
            state = state.where(under_way)
            if state.isEmpty():
                break
            step += 1
            state = scratch.write(_evaluated(rows, state, names, terms, pairs, kinds, p), f"step{step}")
        finished = done[0]
        for more in done[1:]:
            finished = finished.union(more)
        result = Scratch(df.sparkSession, "logistic").write(_errors(rows, finished, names, terms, pairs, kinds, p, include_intercept), "result")
        scratch.drop()
    finally:
        rows.unpersist()
    return result.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], *result.columns[len(names) :])


def _evaluated(rows: DataFrame, state: DataFrame, names: list[str], terms: list[Column], pairs: list[tuple[int, int]], kinds: str, p: int) -> DataFrame:
    at = state.select(*[F.col(n).alias(f"s_{n}") for n in names], "candidate")
    eta = sum((F.col("candidate")[k] * t for k, t in enumerate(terms)), F.lit(0.0))
    joined = rows.join(at, _same(names, "s_")).withColumn("p", one.probability(eta))
    pi, y = F.col("p"), F.col("y")
    sure = F.least(F.greatest(pi, F.lit(one.CLIP)), F.lit(1 - one.CLIP))
    weight = F.greatest(pi * (1 - pi), F.lit(one.FLOOR))
    found = joined.groupBy(*names).agg(
        F.sum(y * F.log(sure) + (1 - y) * F.log(1 - sure)).alias("new_likelihood"),
        F.count_if((pi > one.EXTREME) & (pi < 1 - one.EXTREME)).alias("inside"),
        F.array(*[F.sum(t * (y - pi)) for t in terms]).alias("new_gradient"),
        F.array(*[F.sum(terms[i] * terms[j] * weight) for i, j in pairs]).alias("new_info"),
    )
    found = found.select(*[F.col(n).alias(f"f_{n}") for n in names], "new_likelihood", "inside", "new_gradient", "new_info")
    both = state.join(found, _same(names, "f_")).drop(*[f"f_{n}" for n in names])

    def advance(batches):
        for b in batches:
            made = [_advance(r, p) for r in b.to_pylist()]
            numbers = pa.list_(pa.float64())
            types = {"n": pa.int64(), "ones": pa.float64(), "reach": numbers, "beta": numbers, "likelihood": pa.float64(), "gradient": numbers, "info": numbers, "candidate": numbers, "direction": numbers, "step": pa.float64(), "halvings": pa.int32(), "steps": pa.int64(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array([m[c] for m in made], t) for c, t in types.items())], names=[*names, *types])

    return both.mapInArrow(advance, f"{kinds}, {_STATE}")


def _errors(rows: DataFrame, finished: DataFrame, names: list[str], terms: list[Column], pairs: list[tuple[int, int]], kinds: str, p: int, intercept: bool) -> DataFrame:
    def invert(batches):
        for b in batches:
            infos = b.column(len(names)).to_pylist()
            breads = [linalg.inverse(linalg.unpacked(x, p)).ravel().tolist() for x in infos]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], b.column(len(names) + 1), pa.array(breads, pa.list_(pa.float64()))], names=[*names, "beta", "bread"])

    fitted = finished.where("error is null").select(*names, "info", "beta").mapInArrow(invert, f"{kinds}, beta array<double>, bread array<double>")
    at = fitted.select(*[F.col(n).alias(f"s_{n}") for n in names], "beta", "bread")
    eta = sum((F.col("beta")[k] * t for k, t in enumerate(terms)), F.lit(0.0))
    form = sum((F.col("bread")[i * p + j] * terms[i] * terms[j] for i in range(p) for j in range(p)), F.lit(0.0))
    joined = rows.join(at, _same(names, "s_")).withColumn("p", one.probability(eta)).withColumn("h", F.col("p") * (1 - F.col("p")) * form)
    e, h = F.col("y") - F.col("p"), F.col("h")
    weight = F.when(h < inference.MOST_LEVERAGE, e * e / ((1 - h) * (1 - h)))
    meats = joined.groupBy(*names).agg(F.max(h).alias("most"), F.array(*[F.sum(terms[i] * terms[j] * weight) for i, j in pairs]).alias("meat"))
    breads = fitted.select(*[F.col(n).alias(f"b_{n}") for n in names], "bread")
    meats = meats.select(*[F.col(n).alias(f"m_{n}") for n in names], "most", "meat")
    whole = finished.join(breads, _same(names, "b_"), "left").join(meats, _same(names, "m_"), "left").select(*names, "n", "ones", "beta", "likelihood", "steps", "error", "bread", "most", "meat")

    def finish(batches):
        c = int(intercept)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for r in b.to_pylist():
                error, beta, errors, pseudo = r["error"], r["beta"] if r["error"] is None else None, None, None
                if beta is not None:
                    null = one.null_likelihood(r["n"], r["ones"])
                    pseudo = 1 - r["likelihood"] / null if null else 0.0
                    if r["most"] >= inference.MOST_LEVERAGE:
                        error = "Extreme leverage detected; HC3 standard errors are undefined or unstable"
                    else:
                        errors = inference.sandwich_errors(np.array(r["bread"]).reshape(p, p), linalg.unpacked(r["meat"], p)).tolist()
                values = (r["n"], beta[c:] if beta else None, beta[0] if beta and c else None, errors[c:] if errors else None, errors[0] if errors and c else None, r["steps"], r["likelihood"] if beta else None, pseudo, error)
                for o, x in zip(out, values, strict=True):
                    o.append(x)
            numbers = pa.list_(pa.float64())
            types = (pa.int64(), numbers, pa.float64(), numbers, pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            labels = ["n_samples", "coefficients", "intercept", "standard_errors", "intercept_se", "iterations", "log_likelihood", "pseudo_r_squared", "error"]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names=[*names, *labels])

    return whole.mapInArrow(finish, f"{kinds}, n_samples bigint, coefficients array<double>, intercept double, standard_errors array<double>, intercept_se double, iterations bigint, log_likelihood double, pseudo_r_squared double, error string")
