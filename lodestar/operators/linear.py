"""Ordinary least squares with HC3, cluster-robust or wild-cluster-bootstrap standard errors.

Two passes over the rows: sums of products give the coefficients, and with them
as literals a second pass gives residuals, leverages and the middle of the
sandwich, or the cluster scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import linalg
from lodestar.operators import inference
from lodestar.operators.results import LinearRegressionResult
from lodestar.plans.moments import Design, double
from lodestar.plans.stored import Scratch

#: HC3's weight of a row with residual ``e`` and leverage ``h``.
WEIGHT = f"case when h < {double(inference.MOST_LEVERAGE)} then e * e / ((1 - h) * (1 - h)) end"


def linear_regression(
    df: DataFrame, x_cols: str | list[str], y_col: str, include_intercept: bool = True, cluster: str | None = None, bootstrap: bool = False, bootstrap_iterations: int = 1000, seed: int | None = None, bootstrap_method: str = "rademacher"
) -> LinearRegressionResult:
    """Regress ``y_col`` on ``x_cols``.

    Standard errors are HC3 without ``cluster``, else cluster-robust, or from a
    wild cluster bootstrap. Any numeric columns do. Rows are never dropped:
    nulls and NaN make the regression fail with ValueError.
    """
    ask = inference.request(df, x_cols, y_col, include_intercept, cluster, bootstrap, bootstrap_iterations, seed, bootstrap_method)
    design = Design(df, ask.x_cols, y_col, include_intercept, cluster)
    n, gram, right, spread = _first_pass(design)
    if n == 0:
        raise ValueError("Cannot perform regression on empty data")
    if n < design.size:
        raise ValueError(f"Not enough samples: need at least {design.size} samples for {design.size} parameters")
    bread = linalg.inverse(gram)
    beta = linalg.solution(bread, right)
    residual = f"(y - {design.along(beta)})"
    if cluster is None:
        squares, errors = _second_pass(design, beta, bread, residual)
        found, kind = None, None
    else:
        errors, found, kind = inference.clustered(ask, design, residual, bread, n)
        squares = found.squares
        inference.advise(ask, found, "Wild cluster")
        if found.largest > n // 2:
            ask.warn(f"Cluster '{found.largest_name}' contains {100 * found.largest / n:.0f}% of observations; standard errors may be unreliable.")
    k = int(include_intercept)
    return LinearRegressionResult(
        beta[k:].tolist(),
        float(beta[0]) if k else None,
        float(1 - squares / spread) if spread else 0.0,
        n,
        errors[k:].tolist(),
        float(errors[0]) if k else None,
        found.count if found else None,
        kind,
        bootstrap_iterations if bootstrap else None,
        ask.warnings,
    )


def _first_pass(design: Design) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Rows, ``X'X``, ``X'y`` and the sum of squares of ``y`` around its mean."""
    p = design.size
    around = ["count(*)", "var_pop(y)"]
    if design.native:
        row = design.collect([*around, *design.products(), *[f"sum({t} * y)" for t in design.terms]])
        n, upper, right = int(row[0]), row[2 : 2 + p * (p + 1) // 2], row[2 + p * (p + 1) // 2 :]
        return n, linalg.unpacked(upper, p), np.array(right), n * row[1]

    def block(x, y):
        return np.concatenate([linalg.packed(x.T @ x), x.T @ y]), np.zeros(0)

    row = design.collect(around)
    sums, _ = design.blocks(block, p * (p + 1) // 2 + p, 0)
    return int(row[0]), linalg.unpacked(sums[:-p], p), sums[-p:], row[0] * row[1]


def leverage_refused(count: int, most: float) -> ValueError:
    return ValueError(f"{count} observations have leverage ≥ {inference.MOST_LEVERAGE} (largest {most:.4f}); HC3 standard errors are undefined or unstable")


def _second_pass(design: Design, beta: np.ndarray, bread: np.ndarray, residual: str) -> tuple[float, np.ndarray]:
    """The sum of squared residuals and HC3 standard errors: zeros for an exact fit."""
    p = design.size
    if design.native:
        rows = design.rows.selectExpr("*", f"{residual} as e", f"{design.form(bread)} as h")
        row = design.collect(["sum(e * e)", "max(abs(e))", "max(h)", f"count_if(h >= {double(inference.MOST_LEVERAGE)})", *design.products(WEIGHT)], rows)
        squares, largest, most, refused, meat = row[0], row[1], row[2], int(row[3]), row[4:]
    else:

        def block(x, y):
            e = y - x @ beta
            h = np.einsum("ij,jk,ik->i", x, bread, x, optimize=True)
            over = h >= inference.MOST_LEVERAGE
            w = np.where(over, 0.0, (e / np.where(over, 1.0, 1 - h)) ** 2)
            return np.concatenate([[e @ e, over.sum()], linalg.packed((x * w[:, None]).T @ x)]), np.array([np.abs(e).max(), h.max()])

        sums, tops = design.blocks(block, 2 + p * (p + 1) // 2, 2)
        squares, refused, meat, largest, most = sums[0], int(sums[1]), sums[2:], tops[0], tops[1]
    if largest == 0.0:
        return squares, np.zeros(p)
    if refused:
        raise leverage_refused(refused, most)
    return squares, inference.sandwich_errors(bread, linalg.unpacked(meat, p))


def linear_regression_by(df: DataFrame, keys: str | list[str], x_cols: str | list[str], y_col: str, include_intercept: bool = True) -> DataFrame:
    """A regression with HC3 errors for each group: a row of ``keys``, ``n_samples, coefficients, intercept, r_squared, standard_errors, intercept_se, error``.

    Groups are only aggregated and their coefficients, a stored table of a row
    for each group, joined back, so no group has to fit a task: the table is
    broadcast if its size allows, else Spark can split a large group's rows.
    Rows are read twice. Where a group can't be fitted ``error`` says why and the
    estimates are null.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    x_cols = [x_cols] if isinstance(x_cols, str) else list(x_cols)
    names = [f"k{n}" for n in range(len(keys))]
    design = Design(df, x_cols, y_col, include_intercept)
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)], number(y_col).alias("y"), *[number(c).alias(f"x{k}") for k, c in enumerate(x_cols)])
    p, terms = design.size, design.terms
    first = rows.groupBy(*names).agg(F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("spread"), F.array(*map(F.expr, design.products())).alias("gram"), F.array(*[F.expr(f"sum({t} * y)") for t in terms]).alias("rhs"))

    def solve(batches):
        for b in batches:
            n, grams, rights = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n", "gram", "rhs"))
            out: tuple[list, list, list] = ([], [], [])
            for k in range(b.num_rows):
                try:
                    if n[k] < p:
                        raise ValueError(f"Not enough samples: need at least {p} samples for {p} parameters")
                    bread = linalg.inverse(linalg.unpacked(grams[k], p))
                    found = (linalg.solution(bread, np.array(rights[k])).tolist(), bread.ravel().tolist(), None)
                except ValueError as e:
                    found = (None, None, str(e))
                for o, x in zip(out, found, strict=True):
                    o.append(x)
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], names=[*b.schema.names, "beta", "bread", "error"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    fitted = first.mapInArrow(solve, f"{kinds}, n bigint, spread double, gram array<double>, rhs array<double>, beta array<double>, bread array<double>, error string").drop("gram", "rhs")
    fitted = Scratch(df.sparkSession, "groups").write(fitted, "fitted")
    back = fitted.where("beta is not null").select(*[F.col(n).alias(f"f_{n}") for n in names], "beta", "bread")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"f_{n}"))
    joined = rows.join(back, same)
    e = " + ".join(f"beta[{k}] * {t}" for k, t in enumerate(terms))
    h = " + ".join(f"bread[{i * p + j}] * {terms[i]} * {terms[j]}" for i in range(p) for j in range(p))
    joined = joined.selectExpr("*", f"y - ({e}) as e", f"{h} as h")
    second = joined.groupBy(*names).agg(F.sum(F.col("e") * F.col("e")).alias("squares"), F.max(F.abs("e")).alias("largest"), F.max("h").alias("most"), F.array(*map(F.expr, design.products(WEIGHT))).alias("meat"))
    seconds = second.select(*[F.col(n).alias(f"s_{n}") for n in names], "squares", "largest", "most", "meat")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"s_{n}"))
    both = fitted.join(seconds, same, "left")

    def finish(batches):
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("beta", "bread", "error", "squares", "spread", "largest", "most", "meat")}
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for k in range(b.num_rows):
                beta, error, errors, r2 = get["beta"][k], get["error"][k], None, None
                if beta is not None:
                    spread = get["spread"][k]
                    r2 = 1 - get["squares"][k] / spread if spread else 0.0
                    if get["largest"][k] == 0.0:
                        errors = [0.0] * p
                    elif get["most"][k] >= inference.MOST_LEVERAGE:
                        error = f"leverage ≥ {inference.MOST_LEVERAGE}; HC3 standard errors are undefined or unstable"
                    else:
                        bread = np.array(get["bread"][k]).reshape(p, p)
                        errors = inference.sandwich_errors(bread, linalg.unpacked(get["meat"][k], p)).tolist()
                c = int(include_intercept)
                found = (beta[c:] if beta else None, beta[0] if beta and c else None, r2, errors[c:] if errors else None, errors[0] if errors and c else None, error)
                for o, x in zip(out, found, strict=True):
                    o.append(x)
            numbers = pa.list_(pa.float64())
            kinds = (numbers, pa.float64(), pa.float64(), numbers, pa.float64(), pa.string())
            columns = [b.column(b.schema.get_field_index(c)) for c in [*names, "n"]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], names=[*names, "n_samples", "coefficients", "intercept", "r_squared", "standard_errors", "intercept_se", "error"])

    done = both.select(*names, "n", "spread", "beta", "bread", "error", "squares", "largest", "most", "meat")
    result = done.mapInArrow(finish, f"{kinds}, n_samples bigint, coefficients array<double>, intercept double, r_squared double, standard_errors array<double>, intercept_se double, error string")
    return result.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], *result.columns[len(names) :])
