"""The registered queries of the estimators, and SQL for the same rows.

Sums of doubles depend on the order of addition, so both sides round to a few
digits beyond what the estimates mean.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import linalg, rng
from lodestar.functions.simplex import project
from lodestar.operators import inference, sdid, synthetic_control
from lodestar.operators.linear import _first_pass, linear_regression, linear_regression_by
from lodestar.operators.logistic import logistic_regression
from lodestar.operators.logistic_by import logistic_regression_by
from lodestar.plans import panel as panels
from lodestar.plans.moments import Design
from lodestar.sources.tables import table
from lodestar.streaming.ols import windowed_regression

Query = Callable[[SparkSession, str], DataFrame]

SEED, DRAWS = 42, 200


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of doubles, integers and strings; doubles come rounded."""
    kinds = {float: "double", int: "bigint", str: "string", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _quietly(call):
    """The advice that estimators give as warnings is in their results, too."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return call()


# Linear regression


def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice")
    return _row(spark, slope=round(r.slope, 6), intercept=round(r.intercept, 4), r_squared=round(r.r_squared, 9), n_samples=r.n_samples)


def ols_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice", include_intercept=False)
    return _row(spark, slope=round(r.slope, 6), r_squared=round(r.r_squared, 8))


def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression(_lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    a, b, c = r.coefficients
    return _row(spark, b_quantity=round(a, 5), b_discount=round(b, 3), b_tax=round(c, 3), intercept=round(r.intercept, 3), r_squared=round(r.r_squared, 8))


def ols_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression_by(_lines(spark, sf_dir), "l_returnflag", "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "n_samples", F.round(F.col("coefficients")[0], 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r_squared", 9).alias("r_squared"))


def hc3_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression_by(_lines(spark, sf_dir), "l_returnflag", "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", F.round(F.col("standard_errors")[0], 5).alias("se_slope"), F.round("intercept_se", 4).alias("se_intercept"))


def ols_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of the outcome on a standardised covariate, without its outer values."""
    lines = _lines(spark, sf_dir)
    mean, spread = lines.agg(F.avg("l_quantity"), F.stddev_samp("l_quantity")).first()
    rows = lines.select(((F.col("l_quantity") - mean) / spread).alias("z"), F.log("l_extendedprice").alias("log_price")).where(F.abs("z") < 1.5)
    r = linear_regression(rows, "z", "log_price")
    return _row(spark, slope=round(r.slope, 8), intercept=round(r.intercept, 7), n_samples=r.n_samples)


def hc3_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice")
    return _row(spark, se_slope=round(r.standard_errors[0], 6), se_intercept=round(r.intercept_se, 5))


def hc3_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = linear_regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice", include_intercept=False)
    return _row(spark, se_slope=round(r.standard_errors[0], 6))


def leverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of leverages is the number of parameters."""
    design = Design(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", True)
    _, gram, _, _ = _first_pass(design)
    h = F.expr(design.form(linalg.inverse(gram)))
    return design.rows.agg(F.round(F.max(h), 10).alias("max_leverage"), F.round(F.sum(h), 6).alias("sum_leverage"))


# Clusters


def _clustered_design(spark: SparkSession, sf_dir: str) -> tuple[Design, np.ndarray, str]:
    design = Design(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", True, "l_suppkey")
    _, gram, right, _ = _first_pass(design)
    bread = linalg.inverse(gram)
    return design, bread, f"(y - {design.along(linalg.solution(bread, right))})"


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    design, _, residual = _clustered_design(spark, sf_dir)
    return inference.scores(design, residual).select(F.col("g").alias("l_suppkey"), "n", F.round("s0", 2).alias("s0"), F.round("s1", 1).alias("s1"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cluster_sizes(spark, sf_dir)
    return sizes.agg(F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.max("n") > F.floor(F.sum("n") / 2)).alias("imbalanced"))


def _errors(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    r = _quietly(lambda: linear_regression(_lines(spark, sf_dir), "l_quantity", "l_extendedprice", cluster="l_suppkey", **how))
    return _row(spark, se_slope=round(r.standard_errors[0], 6), se_intercept=round(r.intercept_se, 5), n_clusters=r.n_clusters)


def cluster_se_analytical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir)


def wild_bootstrap_rademacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir, bootstrap=True, bootstrap_iterations=DRAWS, seed=SEED)


def wild_bootstrap_webb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir, bootstrap=True, bootstrap_iterations=DRAWS, seed=SEED, bootstrap_method="webb")


def splitmix64_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = np.arange(1000)
    return spark.createDataFrame([(int(i), str(u)) for i, u in zip(k, rng.draws(SEED, k), strict=True)], "k bigint, draw string")


def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = np.arange(1000)
    both = zip(k, rng.weights("rademacher", SEED, k), rng.weights("webb", SEED, k), strict=True)
    return spark.createDataFrame([(int(i), float(r), round(float(w), 9)) for i, r, w in both], "k bigint, rademacher double, webb double")


# Logistic regression


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.log("n_chars").alias("log_chars"))
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id")


def logit_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logistic_regression(_toxic(spark, sf_dir), "log_chars", "toxic")
    return _row(spark, b0=round(r.intercept, 6), b1=round(r.coefficients[0], 6), log_likelihood=round(r.log_likelihood, 6), pseudo_r_squared=round(r.pseudo_r_squared, 8), n_samples=r.n_samples)


def logit_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logistic_regression(_toxic(spark, sf_dir), "log_chars", "toxic")
    return _row(spark, se0=round(r.intercept_se, 6), se1=round(r.standard_errors[0], 6))


def logit_cluster_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: logistic_regression(_toxic(spark, sf_dir), "log_chars", "toxic", cluster="source"))
    return _row(spark, se0=round(r.intercept_se, 6), se1=round(r.standard_errors[0], 6), n_clusters=r.n_clusters)


def logit_score_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: logistic_regression(_toxic(spark, sf_dir), "log_chars", "toxic", cluster="source", bootstrap=True, bootstrap_iterations=DRAWS, seed=SEED))
    return _row(spark, se0=round(r.intercept_se, 6), se1=round(r.standard_errors[0], 6))


def logit_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by value for each quarter of the day."""
    events = table(spark, sf_dir, "events").select("value", F.floor(F.hour("ts") / 6).cast("int").alias("part_of_day"), (F.col("event_type") == "purchase").cast("double").alias("purchase"))
    r = logistic_regression_by(events, "part_of_day", "value", "purchase")
    numbers = (F.round("intercept", 6).alias("b0"), F.round(F.col("coefficients")[0], 8).alias("b1"), F.round("log_likelihood", 3).alias("log_likelihood"))
    return r.select("part_of_day", "n_samples", *numbers, F.round("intercept_se", 6).alias("se0"), F.round(F.col("standard_errors")[0], 8).alias("se1"))


def logit_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate that parts the outcomes has no estimate; each brand says so."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("size"), (F.col("p_size") > F.when(F.col("p_brand") < "Brand#3", 25).otherwise(0)).cast("double").alias("large"))
    r = logistic_regression_by(parts, "p_brand", "size", "large")
    fault = F.when(F.startswith("error", F.lit("Perfect separation")), "separated").when(F.contains("error", F.lit("both 0 and 1")), "one class").otherwise("other")
    return r.select("p_brand", "n_samples", fault.alias("fault"), F.isnull("coefficients").alias("without_estimate"))


def wild_bootstrap_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of one row each, which only the bootstrap takes."""
    r = _quietly(lambda: linear_regression(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", cluster="s_suppkey", bootstrap=True, bootstrap_iterations=DRAWS, seed=SEED))
    return _row(spark, se_slope=round(r.standard_errors[0], 5), se_intercept=round(r.intercept_se, 4), n_clusters=r.n_clusters)


def logit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value", (F.col("event_type") == "purchase").cast("double").alias("purchase"))
    r = logistic_regression(events, "value", "purchase")
    return _row(spark, b0=round(r.intercept, 6), b1=round(r.coefficients[0], 8), log_likelihood=round(r.log_likelihood, 3), n_samples=r.n_samples)


# Panels


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments by quarter; one is treated from 2000 on."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("period"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("unit"))
    cells = orders.join(customers, "o_custkey").groupBy("unit", "period").agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("y"))
    return cells.withColumn("treated", ((F.col("unit") == "BUILDING") & (F.col("period") >= 20001)).cast("int"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events by day; one is treated for the last ten days."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("unit"), F.dayofmonth("ts").alias("period"), "value")
    cells = events.groupBy("unit", "period").agg(F.round(F.avg("value"), 6).alias("y"))
    return cells.withColumn("treated", ((F.col("unit") == "purchase") & (F.col("period") >= 21)).cast("int"))


_PANEL = ("unit", "period", "y", "treated")


def panel_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _segments(spark, sf_dir)
    units = panels.labels(cells, "unit", "treated").select(F.lit("unit").alias("kind"), "key", "treated")
    return units.union(panels.labels(cells, "period", "treated").select(F.lit("period"), F.col("key").cast("string"), "treated"))


def panel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panels.check(_segments(spark, sf_dir), *_PANEL, "SC")
    return _row(spark, n_rows=found["rows"], n_units=found["units"], n_periods=found["periods"], balanced=found["rows"] == found["units"] * found["periods"])


def panel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.series(_segments(spark, sf_dir), "unit", "period", "y")
    return rows.select("unit", F.posexplode("outcomes").alias("place", "y"))


def panel_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.gram(_segments(spark, sf_dir), "unit", "period", "y").select("unit_a", "unit_b", F.round("product", 4).alias("product"))


def _control(spark: SparkSession, sf_dir: str, method: str, **how) -> tuple:
    cells = _segments(spark, sf_dir)
    return _quietly(lambda: synthetic_control.synthetic_control(cells, *_PANEL, method=method, **how))


def _control_row(spark: SparkSession, r) -> DataFrame:
    weights = {f"w{k}": round(w, 5) + 0.0 for k, w in enumerate(r.unit_weights, 1)}
    return _row(spark, att=round(r.att, 4), rmse=round(r.pre_treatment_rmse, 5), **weights)


def sc_traditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control_row(spark, _control(spark, sf_dir, "traditional", compute_se=False))


def sc_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control_row(spark, _control(spark, sf_dir, "robust", compute_se=False))


def sc_penalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control_row(spark, _control(spark, sf_dir, "penalized", lambda_param=10.0, compute_se=False))


def sc_penalized_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _control(spark, sf_dir, "penalized", compute_se=False)
    return _control_row(spark, r).withColumn("penalty", F.lit(r.lambda_selected))


def sc_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control_row(spark, _control(spark, sf_dir, "augmented", compute_se=False))


def sc_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _control(spark, sf_dir, "traditional")
    return _row(spark, att=round(r.att, 4), se=round(r.standard_error, 4), n_placebo=r.n_placebo_used)


def sdid_unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: sdid.synthetic_did(_kinds(spark, sf_dir), *_PANEL, bootstrap_iterations=0))
    return spark.createDataFrame([(k, round(w, 5)) for k, w in enumerate(r.unit_weights, 1)], "place bigint, weight double")


def sdid_time_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: sdid.synthetic_did(_kinds(spark, sf_dir), *_PANEL, bootstrap_iterations=0))
    return spark.createDataFrame([(k, round(w, 5)) for k, w in enumerate(r.time_weights, 1)], "place bigint, weight double")


def sdid_att(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: sdid.synthetic_did(_kinds(spark, sf_dir), *_PANEL, bootstrap_iterations=0))
    return _row(spark, att=round(r.att, 4), pre_treatment_fit=round(r.pre_treatment_fit, 4))


def sdid_placebo_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sdid.placebo_units(SEED, DRAWS, 4)
    return spark.createDataFrame([(k, int(p)) for k, p in enumerate(places)], "iteration bigint, place bigint")


def sdid_placebo_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _quietly(lambda: sdid.synthetic_did(_kinds(spark, sf_dir), *_PANEL, bootstrap_iterations=DRAWS, seed=SEED))
    return _row(spark, att=round(r.att, 4), se=round(r.standard_error, 4), used=r.bootstrap_iterations_used)


def simplex_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' mean sizes less fifty, projected."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_size") - 50, 6).alias("v")).orderBy("p_brand").collect()
    weights = project(np.array([r["v"] for r in rows]))
    return spark.createDataFrame([(r["p_brand"], round(float(w), 6)) for r, w in zip(rows, weights, strict=True)], "p_brand string, weight double")


def windowed_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value", F.col("user_id").cast("double").alias("user"))
    r = windowed_regression(events, "ts", "user", "value", "7 days", keys=("event_type",))
    return r.select(F.col("window_start").cast("date").cast("string").alias("day"), "event_type", "n_samples", F.round("slope", 7).alias("slope"), F.round("intercept", 4).alias("intercept"))


_ALL: tuple[Query, ...] = (
    ols_simple, ols_no_intercept, ols_multi, ols_grouped, hc3_grouped, ols_transformed, hc3_simple, hc3_no_intercept, leverage_stats, cluster_scores, cluster_sizes, cluster_balance, cluster_se_analytical,
    wild_bootstrap_rademacher, wild_bootstrap_webb, splitmix64_stream, bootstrap_weights, logit_mle, logit_hc3, logit_cluster_se, logit_score_bootstrap, logit_events, logit_grouped, logit_separated, wild_bootstrap_singletons, panel_detect, panel_balance, panel_matrix,
    panel_gram, sc_traditional, sc_robust, sc_penalized, sc_penalized_auto, sc_augmented, sc_placebo, sdid_unit_weights, sdid_time_weights, sdid_att, sdid_placebo_draws, sdid_placebo_se, simplex_projection, windowed_ols,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}


# SQL

_ROWS = """
WITH t AS MATERIALIZED (SELECT l_quantity AS x, l_extendedprice AS y, l_suppkey AS g, l_returnflag AS f FROM lineitem),
a AS (
    SELECT n, sxx / d AS a00, -sx / d AS a01, n / d AS a11, sy, sxy
    FROM (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, count(*)::DOUBLE * sum(x * x) - sum(x) * sum(x) AS d FROM t)
),
b AS (SELECT *, a00 * sy + a01 * sxy AS b0, a01 * sy + a11 * sxy AS b1 FROM a),
r AS (SELECT t.*, b.*, y - b0 - b1 * x AS e, a00 + 2 * a01 * x + a11 * x * x AS h FROM t, b)
"""

_SCORES = _ROWS + """,
s AS (SELECT g, count(*) AS n, sum(e) AS s0, sum(e * x) AS s1, any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11 FROM r GROUP BY g)
"""


def _draws(seed: int, count: int | str) -> str:
    """As many draws of the generator as a number or a query says, by number, in integers wide enough not to overflow."""
    wrap = "18446744073709551616::UHUGEINT"
    return f"""
u AS (SELECT k, xor(z, z >> 31) AS u FROM
    (SELECT k, ((xor(z, z >> 27))::UHUGEINT * {rng.MIX_2}::UHUGEINT % {wrap})::UBIGINT AS z FROM
    (SELECT k, ((xor(z, z >> 30))::UHUGEINT * {rng.MIX_1}::UHUGEINT % {wrap})::UBIGINT AS z FROM
    (SELECT k, (({seed}::UHUGEINT + (k::UHUGEINT + 1) * {rng.GAMMA}::UHUGEINT) % {wrap})::UBIGINT AS z FROM (SELECT unnest(range(({count})::BIGINT)) AS k)))))
"""


_WEBB = "([" + ", ".join(repr(float(x)) for x in rng.WEBB) + "]::DOUBLE[])[(u % 6)::INT + 1]"
_RADEMACHER = "CASE WHEN u % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


def _bootstrap_sql(scores: str, weight: str, digits: tuple[int, int], names: tuple[str, str], tail: str = "") -> str:
    """Standard deviations over draws; the draws number as many as clusters times iterations."""
    return f"""{scores},
i AS (SELECT row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gs, s.* FROM s),
{_draws(SEED, f"SELECT count(*) * {DRAWS} FROM s")},
w AS (SELECT k // gs AS draw, k % gs AS gi, {weight} AS w FROM u, (SELECT any_value(gs) AS gs FROM i) WHERE k < gs * {DRAWS}),
d AS (SELECT draw, sum(w * s0) AS r0, sum(w * s1) AS r1, any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11 FROM w JOIN i USING (gi) GROUP BY draw)
SELECT round(stddev_samp(a01 * r0 + a11 * r1), {digits[1]}) AS {names[1]}, round(stddev_samp(a00 * r0 + a01 * r1), {digits[0]}) AS {names[0]}{tail} FROM d
"""


_LOGIT = """
WITH RECURSIVE t AS MATERIALIZED (SELECT ln(n_chars) AS x, toxic::DOUBLE AS y, source AS g FROM labels JOIN documents USING (doc_id)),
st AS (
    SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
    UNION ALL
    SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT k, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT st.*, x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM st, t WHERE k < 12) GROUP BY k, b0, b1)
),
b AS (SELECT b0, b1 FROM st WHERE k = 12),
p AS (SELECT t.*, b.*, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM t, b),
a AS (SELECT h11 / d AS a00, -h01 / d AS a01, h00 / d AS a11, n FROM (SELECT *, h00 * h11 - h01 * h01 AS d FROM (SELECT count(*) AS n, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11 FROM p))),
r AS (SELECT p.*, a.*, y - p AS e, p * (1 - p) * (a00 + 2 * a01 * x + a11 * x * x) AS h FROM p, a)
"""

_LOGIT_SCORES = _LOGIT + """,
s AS (SELECT g, count(*) AS n, sum(e) AS s0, sum(e * x) AS s1, any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11 FROM r GROUP BY g)
"""


def _sandwich(source: str, digits: tuple[int, int], names: tuple[str, str], tail: str = "") -> str:
    """The clustered sandwich from scores."""
    return f"""{source},
k AS (
    SELECT any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11, count(*) AS gs,
        (count(*) / (count(*) - 1.0::DOUBLE)) * ((sum(n) - 1.0::DOUBLE) / (sum(n) - 2.0::DOUBLE)) AS c, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s
)
SELECT round(sqrt(c * (a01 * a01 * m00 + 2 * a01 * a11 * m01 + a11 * a11 * m11)), {digits[1]}) AS {names[1]},
    round(sqrt(c * (a00 * a00 * m00 + 2 * a00 * a01 * m01 + a01 * a01 * m11)), {digits[0]}) AS {names[0]}{tail} FROM k
"""


def _hc3(source: str, digits: tuple[int, int], names: tuple[str, str]) -> str:
    return f"""{source},
k AS (SELECT any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11, sum(w) AS m00, sum(w * x) AS m01, sum(w * x * x) AS m11 FROM (SELECT *, e * e / ((1 - h) * (1 - h)) AS w FROM r))
SELECT round(sqrt(a01 * a01 * m00 + 2 * a01 * a11 * m01 + a11 * a11 * m11), {digits[1]}) AS {names[1]}, round(sqrt(a00 * a00 * m00 + 2 * a00 * a01 * m01 + a01 * a01 * m11), {digits[0]}) AS {names[0]} FROM k
"""


_SEGMENTS = """c AS MATERIALIZED (
    SELECT *, (unit = 'BUILDING' AND period >= 20001)::INT AS treated FROM (
        SELECT c_mktsegment AS unit, year(o_orderdate) * 10 + quarter(o_orderdate) AS period, round(avg(o_totalprice) / 1000, 6) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
)"""

_KINDS = """c AS MATERIALIZED (
    SELECT *, (unit = 'purchase' AND period >= 21)::INT AS treated FROM (
        SELECT event_type AS unit, day(ts) AS period, round(avg(value), 6) AS y FROM events GROUP BY ALL)
)"""

#: Cells with whether their unit is ever treated and their period is after treatment.
_MARKED = """m AS MATERIALIZED (SELECT *, max(treated) OVER (PARTITION BY unit) AS tu, max(treated) OVER (PARTITION BY period) AS tp FROM c)"""


def _frank_wolfe(most: int, tol: float) -> str:
    """The solver's path from ``p (gram, v, size, zeta, const)``, as state rows; ``fw`` has the weights."""
    equal = "list_transform(range(size), lambda i: 1.0::DOUBLE / size)"
    return f"""
st AS (
    SELECT 0 AS k, {equal} AS w, 1.7976931348623157e308::DOUBLE AS bo, 1.7976931348623157e308::DOUBLE AS bg, {equal} AS bw, false AS done FROM p
    UNION ALL
    SELECT k + 1, CASE WHEN conv THEN w ELSE list_transform(range(size), lambda i: w[i + 1] * (1 - 2.0::DOUBLE / (k + 2)) + CASE WHEN i + 1 = s THEN 2.0::DOUBLE / (k + 2) ELSE 0.0 END) END, nbo, nbg, nbw, conv
    FROM (SELECT *, gap / (abs(greatest(nbo, 1.0)) + 1e-10) < {tol!r} AS conv FROM (
        SELECT *, CASE WHEN upd THEN fc ELSE bo END AS nbo, CASE WHEN upd THEN gap ELSE bg END AS nbg, CASE WHEN upd THEN w ELSE bw END AS nbw FROM (
        SELECT *, (k % 100 = 0 OR gap < bg) AND fc < bo AS upd FROM (
        SELECT *, list_position(gr, list_min(gr)) AS s, list_dot_product(gr, w) - list_min(gr) AS gap, list_dot_product(kw, w) - 2 * list_dot_product(w, v) + const AS fc FROM (
        SELECT *, list_transform(range(size), lambda i: 2 * kw[i + 1] - 2 * v[i + 1]) AS gr FROM (
        SELECT st.*, p.*, list_transform(range(p.size), lambda i: list_dot_product(p.gram[i + 1], st.w) + p.zeta * st.w[i + 1]) AS kw FROM st, p WHERE NOT st.done AND st.k < {most}))))))
),
fw AS (SELECT CASE WHEN done THEN w ELSE bw END AS w FROM st ORDER BY k DESC LIMIT 1)"""


def _control_sql(level: str) -> str:
    """Synthetic control of the segments; ``level`` is what is taken off a unit's outcomes for the weights."""
    return f"""
WITH RECURSIVE {_SEGMENTS}, {_MARKED},
d AS MATERIALIZED (SELECT unit, period, tu, y - {level} AS y FROM m WHERE tp = 0),
u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM m WHERE tu = 0)),
g AS (SELECT u1.i, u2.i AS j, sum(d1.y * d2.y) AS v FROM d d1 JOIN d d2 USING (period) JOIN u u1 ON u1.unit = d1.unit JOIN u u2 ON u2.unit = d2.unit GROUP BY ALL),
p AS MATERIALIZED (SELECT
    (SELECT list(l ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS l FROM g GROUP BY i)) AS gram,
    (SELECT list(v ORDER BY i) FROM (SELECT i, sum(d1.y * d2.y) AS v FROM d d1 JOIN u USING (unit) JOIN d d2 ON d2.period = d1.period AND d2.tu = 1 GROUP BY i)) AS v,
    (SELECT count(*) FROM u)::BIGINT AS size, 0.0::DOUBLE AS zeta, 0.0::DOUBLE AS const),
{_frank_wolfe(1000, 1e-6)},
x AS (SELECT tp, period, max(CASE WHEN tu = 1 THEN m.y END) - sum(CASE WHEN tu = 0 THEN fw.w[i] * m.y ELSE 0 END) AS gap FROM m LEFT JOIN u USING (unit), fw GROUP BY ALL)
SELECT round((SELECT avg(gap) FROM x WHERE tp = 1), 4) AS att, round(sqrt((SELECT avg(gap * gap) FROM x WHERE tp = 0)), 5) AS rmse,
    round(w[1], 5) AS w1, round(w[2], 5) AS w2, round(w[3], 5) AS w3, round(w[4], 5) AS w4 FROM fw
"""


_DID = f"""
WITH RECURSIVE {_KINDS}, {_MARKED},
u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM m WHERE tu = 0)),
q AS (SELECT period, row_number() OVER (ORDER BY period) AS t FROM (SELECT DISTINCT period FROM m WHERE tp = 0)),
d AS MATERIALIZED (SELECT i, t, y FROM m JOIN u USING (unit) JOIN q USING (period)),
late AS (SELECT i, avg(y) AS y FROM m JOIN u USING (unit) WHERE tp = 1 GROUP BY i),
early AS (SELECT t, avg(y) AS y FROM m JOIN q USING (period) WHERE tu = 1 GROUP BY t),
spread AS (SELECT stddev_samp(y) AS s FROM d),"""

_DID_UNITS = _DID + """
p AS MATERIALIZED (SELECT
    (SELECT list(l ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS l FROM (SELECT d1.i, d2.i AS j, sum(d1.y * d2.y) AS v FROM d d1 JOIN d d2 USING (t) GROUP BY ALL) GROUP BY i)) AS gram,
    (SELECT list(v ORDER BY i) FROM (SELECT i, sum(d.y * early.y) AS v FROM d JOIN early USING (t) GROUP BY i)) AS v,
    (SELECT count(*) FROM u)::BIGINT AS size, (SELECT count(*) FROM u) ** 0.25 * (SELECT s FROM spread) AS zeta, (SELECT sum(y * y) FROM early) AS const),
""" + _frank_wolfe(200, 1e-3)

_DID_TIMES = _DID + """
p AS MATERIALIZED (SELECT
    (SELECT list(l ORDER BY t) FROM (SELECT t, list(v ORDER BY o) AS l FROM (SELECT d1.t, d2.t AS o, sum(d1.y * d2.y) AS v FROM d d1 JOIN d d2 USING (i) GROUP BY ALL) GROUP BY t)) AS gram,
    (SELECT list(v ORDER BY t) FROM (SELECT t, sum(d.y * late.y) AS v FROM d JOIN late USING (i) GROUP BY t)) AS v,
    (SELECT count(*) FROM q)::BIGINT AS size, (SELECT count(*) FROM q) ** 0.25 * (SELECT s FROM spread) AS zeta, (SELECT sum(y * y) FROM late) AS const),
""" + _frank_wolfe(200, 1e-3)

_PERIODS = re.sub(r"\b(p|st|fw)\b", r"\1_times", _DID_TIMES.removeprefix(_DID))

_DID_EFFECT = _DID_UNITS + "," + _PERIODS + """,
x AS (SELECT t, (SELECT y FROM early WHERE early.t = q.t) - (SELECT sum(fw.w[i] * y) FROM d, fw WHERE d.t = q.t) AS gap FROM q)
SELECT round((SELECT avg(y) FROM m WHERE tu = 1 AND tp = 1) - (SELECT sum(fw.w[i] * y) FROM late, fw) - (SELECT sum(fw_times.w[t] * gap) FROM x, fw_times), 4) AS att,
    round(sqrt((SELECT avg(gap * gap) FROM x)), 4) AS pre_treatment_fit
"""

#: The penalties that are tried; the same for all tables.
_PENALTIES = ", ".join(f"{p!r}::DOUBLE" for p in synthetic_control.PENALTIES)

#: Controls, their outcomes before treatment against the treated unit's, and sums of products.
_DONORS = f"""{_SEGMENTS}, {_MARKED},
u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM m WHERE tu = 0)),
d AS MATERIALIZED (SELECT unit, period, tu, y FROM m WHERE tp = 0),
g AS (SELECT u1.i, u2.i AS j, sum(d1.y * d2.y) AS v FROM d d1 JOIN d d2 USING (period) JOIN u u1 ON u1.unit = d1.unit JOIN u u2 ON u2.unit = d2.unit GROUP BY ALL),
r AS (SELECT i, sum(d1.y * d2.y) AS v FROM d d1 JOIN u USING (unit) JOIN d d2 ON d2.period = d1.period AND d2.tu = 1 GROUP BY i)"""


def _solved(source: str, name: str) -> str:
    """Elimination without exchanges of positive definite systems: ``name (id, x)`` from rows ``id, a`` of ``source``, matrices with the right side as last column."""
    return f"""
{name}_e AS (
    SELECT 1::BIGINT AS k, id, a FROM {source}
    UNION ALL
    SELECT k + 1, id, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = k THEN list_transform(a[k], lambda z: z / a[k][k])
        ELSE list_transform(range(1, len(a) + 2), lambda j: a[i][j] - a[i][k] / a[k][k] * a[k][j]) END) FROM {name}_e WHERE k <= len(a)
),
{name} AS (SELECT id, list_transform(a, lambda z: z[len(a) + 1]) AS x FROM {name}_e WHERE k = len(a) + 1)"""


#: ``w (id, w)``: the penalized solutions for the penalties ``l (id, penalty)``, projected.
_PENALIZED = f"""
a AS (SELECT id, list(row ORDER BY i) AS a FROM (
    SELECT id, i, list_append(list(g.v + CASE WHEN i = j THEN penalty ELSE 0 END ORDER BY j), any_value(r.v)) AS row FROM l, g JOIN r USING (i) GROUP BY id, i) GROUP BY id),
{_solved("a", "s")},
o AS (SELECT id, x, list_sort(x, 'DESC') AS down FROM s),
h AS (SELECT id, x, down, list_transform(range(1, len(x) + 1), lambda k: (list_sum(down[1:k]) - 1) / k) AS level FROM o),
w AS (SELECT id, list_transform(x, lambda z: greatest(z - level[list_max(list_filter(range(1, len(x) + 1), lambda k: down[k] - level[k] > 0))], 0)) AS w FROM h)"""

#: The treated unit's distance from its weighted controls in each period, for the weights ``w (id, w)``.
_GAPS = """
x AS (SELECT w.id, tp, period, max(CASE WHEN tu = 1 THEN m.y END) - sum(CASE WHEN tu = 0 THEN w.w[i] * m.y ELSE 0 END) AS gap FROM m LEFT JOIN u USING (unit), w GROUP BY ALL),
f AS (SELECT id, avg(gap) FILTER (tp = 1) AS effect, avg(gap * gap) FILTER (tp = 0) AS mse FROM x GROUP BY id)"""

_SHOWN = ", ".join(f"round(w[{k}], 5) AS w{k}" for k in range(1, 5))


def _penalized_sql(penalties: str, tail: str = "") -> str:
    return f"""
WITH RECURSIVE {_DONORS},
l AS (SELECT row_number() OVER () AS id, penalty FROM (SELECT unnest([{penalties}]) AS penalty)),
{_PENALIZED},
{_GAPS}
SELECT round(effect, 4) AS att, round(sqrt(mse), 5) AS rmse, {_SHOWN}{tail} FROM f JOIN w USING (id) JOIN l USING (id) ORDER BY mse, penalty LIMIT 1
"""


_AUGMENTED = f"""
WITH RECURSIVE {_DONORS},
p AS MATERIALIZED (SELECT (SELECT list(l ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS l FROM g GROUP BY i)) AS gram, (SELECT list(v ORDER BY i) FROM r) AS v, (SELECT count(*) FROM u)::BIGINT AS size, 0.0::DOUBLE AS zeta, 0.0::DOUBLE AS const),
{_frank_wolfe(1000, 1e-6)},
w AS (SELECT 1 AS id, w FROM fw),
{_GAPS},
late AS (SELECT i, avg(y) AS y FROM m JOIN u USING (unit) WHERE tp = 1 GROUP BY i),
q AS (SELECT period, row_number() OVER (ORDER BY period) AS t FROM (SELECT DISTINCT period FROM d)),
k AS (SELECT q1.t, q2.t AS o, sum(d1.y * d2.y) AS v FROM d d1 JOIN d d2 USING (unit) JOIN q q1 ON q1.period = d1.period JOIN q q2 ON q2.period = d2.period WHERE d1.tu = 0 GROUP BY ALL),
b AS (SELECT t, sum(d.y * late.y) AS v FROM d JOIN u USING (unit) JOIN late USING (i) JOIN q USING (period) GROUP BY t),
a AS (SELECT 1 AS id, list(row ORDER BY t) AS a FROM (SELECT t, list_append(list(k.v + CASE WHEN t = o THEN {synthetic_control.RIDGE!r} ELSE 0 END ORDER BY o), any_value(b.v)) AS row FROM k JOIN b USING (t) GROUP BY t)),
{_solved("a", "s")},
z AS (SELECT sum(s.x[t] * (CASE WHEN tu = 1 THEN -1 ELSE w.w[i] END) * d.y) AS bias FROM d JOIN q USING (period) LEFT JOIN u USING (unit), w, s)
SELECT round(effect - bias, 4) AS att, round(sqrt(mse), 5) AS rmse, {_SHOWN} FROM f, z, w
"""


def _frank_wolfe_each(name: str, most: int, tol: float) -> str:
    """The solver's path for each row of ``name_p (id, gram, v, size, zeta, const)``; ``name (id, w)`` has the weights."""
    one = _frank_wolfe(most, tol).strip()
    path = one[: one.index("),\nfw AS")].removeprefix("st AS (")
    path = path.replace("SELECT 0 AS k,", "SELECT id, 0 AS k,").replace("SELECT k + 1,", "SELECT id, k + 1,").replace("FROM st, p WHERE", "FROM st JOIN p USING (id) WHERE").replace("SELECT st.*, p.*,", "SELECT st.*, p.* EXCLUDE (id),")
    path = re.sub(r"\bst\b", f"{name}_st", re.sub(r"\bp\b", f"{name}_p", path))
    return f"{name}_st AS ({path}),\n{name} AS (SELECT id, arg_max(CASE WHEN done THEN w ELSE bw END, k) AS w FROM {name}_st GROUP BY id)"


#: Each control in turn in the treated unit's place, the other controls being those of ``others (id, unit, i)``.
_SC_PLACEBO = f"""
WITH RECURSIVE {_DONORS},
others AS (SELECT a.i AS id, b.unit, row_number() OVER (PARTITION BY a.i ORDER BY b.i) AS i FROM u a JOIN u b ON a.i <> b.i),
t AS (SELECT i AS id, unit FROM u UNION ALL SELECT 0, unit FROM m WHERE tu = 1 GROUP BY unit),
n AS (SELECT id, unit, i FROM others UNION ALL SELECT 0, unit, i FROM u),
gg AS (SELECT a.id, a.i, b.i AS j, sum(d1.y * d2.y) AS v FROM n a JOIN n b USING (id) JOIN d d1 ON d1.unit = a.unit JOIN d d2 ON d2.unit = b.unit AND d2.period = d1.period GROUP BY ALL),
rr AS (SELECT a.id, a.i, sum(d1.y * d2.y) AS v FROM n a JOIN t ON t.id = a.id JOIN d d1 ON d1.unit = a.unit JOIN d d2 ON d2.unit = t.unit AND d2.period = d1.period GROUP BY ALL),
each_p AS MATERIALIZED (SELECT id, gram, v, len(v)::BIGINT AS size, 0.0::DOUBLE AS zeta, 0.0::DOUBLE AS const
    FROM (SELECT id, list(l ORDER BY i) AS gram FROM (SELECT id, i, list(v ORDER BY j) AS l FROM gg GROUP BY id, i) GROUP BY id) JOIN (SELECT id, list(v ORDER BY i) AS v FROM rr GROUP BY id) USING (id)),
{_frank_wolfe_each("each", 1000, 1e-6)},
late AS (SELECT unit, avg(y) AS y FROM m WHERE tp = 1 GROUP BY unit),
e AS (SELECT t.id, any_value(lt.y) - sum(each.w[n.i] * ln.y) AS effect FROM t JOIN each USING (id) JOIN n USING (id) JOIN late lt ON lt.unit = t.unit JOIN late ln ON ln.unit = n.unit GROUP BY t.id)
SELECT round(any_value(effect) FILTER (id = 0), 4) AS att, round(stddev_samp(effect) FILTER (id > 0), 4) AS se, count(*) FILTER (id > 0) AS n_placebo FROM e
"""

#: The effect (id 0), and with each control added to the treated units in turn; averaged over the draws of controls.
_DID_PLACEBO = f"""
WITH RECURSIVE {_KINDS}, {_MARKED},
u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM m WHERE tu = 0)),
ids AS (SELECT 0::BIGINT AS id UNION ALL SELECT i FROM u),
q AS (SELECT period, row_number() OVER (ORDER BY period) AS t FROM (SELECT DISTINCT period FROM m WHERE tp = 0)),
n AS (SELECT id, unit, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM ids JOIN u ON u.i <> ids.id),
v AS MATERIALIZED (SELECT ids.id, m.unit, m.period, m.tp, m.y, n.i, q.t FROM ids JOIN m ON true LEFT JOIN n ON n.id = ids.id AND n.unit = m.unit LEFT JOIN q ON q.period = m.period),
late AS (SELECT id, i, avg(y) AS y FROM v WHERE i IS NOT NULL AND tp = 1 GROUP BY id, i),
early AS (SELECT id, t, avg(y) AS y FROM v WHERE i IS NULL AND tp = 0 GROUP BY id, t),
d AS MATERIALIZED (SELECT id, i, t, y FROM v WHERE i IS NOT NULL AND tp = 0),
spread AS (SELECT id, stddev_samp(y) AS s, count(DISTINCT i) AS units, count(DISTINCT t) AS times FROM d GROUP BY id),
units_p AS MATERIALIZED (SELECT id, gram, v, len(v)::BIGINT AS size, units ** 0.25 * s AS zeta, const FROM spread
    JOIN (SELECT id, list(l ORDER BY i) AS gram FROM (SELECT id, i, list(v ORDER BY j) AS l FROM (SELECT a.id, a.i, b.i AS j, sum(a.y * b.y) AS v FROM d a JOIN d b USING (id, t) GROUP BY ALL) GROUP BY id, i) GROUP BY id) USING (id)
    JOIN (SELECT id, list(v ORDER BY i) AS v FROM (SELECT d.id, d.i, sum(d.y * early.y) AS v FROM d JOIN early USING (id, t) GROUP BY ALL) GROUP BY id) USING (id)
    JOIN (SELECT id, sum(y * y) AS const FROM early GROUP BY id) USING (id)),
times_p AS MATERIALIZED (SELECT id, gram, v, len(v)::BIGINT AS size, times ** 0.25 * s AS zeta, const FROM spread
    JOIN (SELECT id, list(l ORDER BY t) AS gram FROM (SELECT id, t, list(v ORDER BY o) AS l FROM (SELECT a.id, a.t, b.t AS o, sum(a.y * b.y) AS v FROM d a JOIN d b USING (id, i) GROUP BY ALL) GROUP BY id, t) GROUP BY id) USING (id)
    JOIN (SELECT id, list(v ORDER BY t) AS v FROM (SELECT d.id, d.t, sum(d.y * late.y) AS v FROM d JOIN late USING (id, i) GROUP BY ALL) GROUP BY id) USING (id)
    JOIN (SELECT id, sum(y * y) AS const FROM late GROUP BY id) USING (id)),
{_frank_wolfe_each("units", 200, 1e-3)},
{_frank_wolfe_each("times", 200, 1e-3)},
x AS (SELECT early.id, sum(times.w[t] * (early.y - c.y)) AS gap FROM early JOIN times USING (id) JOIN (SELECT d.id, d.t, sum(units.w[i] * d.y) AS y FROM d JOIN units USING (id) GROUP BY ALL) c USING (id, t) GROUP BY early.id),
e AS (SELECT id, post.y - base.y - gap AS effect FROM x JOIN (SELECT id, avg(y) AS y FROM v WHERE i IS NULL AND tp = 1 GROUP BY id) post USING (id) JOIN (SELECT late.id, sum(units.w[i] * late.y) AS y FROM late JOIN units USING (id) GROUP BY late.id) base USING (id)),
{_draws(SEED, DRAWS).strip().replace("(k::UHUGEINT + 1) *", "k::UHUGEINT + 1::UHUGEINT *").replace("u AS (", "rng AS (", 1)}
SELECT round((SELECT effect FROM e WHERE id = 0), 4) AS att, round(stddev_samp(effect), 4) AS se, count(*) AS used FROM rng JOIN e ON e.id = (rng.u % 4)::BIGINT + 1
"""

#: Newton steps of each group from zero, and HC3.
_LOGIT_GROUPED = """
WITH RECURSIVE t AS MATERIALIZED (SELECT value AS x, (event_type = 'purchase')::DOUBLE AS y, (hour(ts) // 6)::INT AS g FROM events),
st AS (
    SELECT 0 AS k, g, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM t GROUP BY g
    UNION ALL
    SELECT k + 1, g, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT k, g, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT st.*, x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM st JOIN t USING (g) WHERE k < 12) GROUP BY k, g, b0, b1)
),
p AS (SELECT t.*, b0, b1, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM t JOIN st USING (g) WHERE k = 12),
a AS (SELECT g, h11 / d AS a00, -h01 / d AS a01, h00 / d AS a11 FROM (SELECT *, h00 * h11 - h01 * h01 AS d FROM (SELECT g, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11 FROM p GROUP BY g))),
r AS (SELECT p.*, a.* EXCLUDE (g), (y - p) ** 2 / (1 - p * (1 - p) * (a00 + 2 * a01 * x + a11 * x * x)) ** 2 AS w FROM p JOIN a USING (g)),
k AS (SELECT g, count(*) AS n, any_value(b0) AS b0, any_value(b1) AS b1, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS l, any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11, sum(w) AS m00, sum(w * x) AS m01, sum(w * x * x) AS m11 FROM r GROUP BY g)
SELECT g AS part_of_day, n AS n_samples, round(b0, 6) AS b0, round(b1, 8) AS b1, round(l, 3) AS log_likelihood,
    round(sqrt(a00 * a00 * m00 + 2 * a00 * a01 * m01 + a01 * a01 * m11), 6) AS se0, round(sqrt(a01 * a01 * m00 + 2 * a01 * a11 * m01 + a11 * a11 * m11), 8) AS se1 FROM k
"""

_SEPARATED = """
SELECT p_brand, n AS n_samples, CASE WHEN ones = n OR ones = 0 THEN 'one class' WHEN above > below THEN 'separated' ELSE 'other' END AS fault, true AS without_estimate
FROM (SELECT p_brand, count(*) AS n, count_if(l) AS ones, min(p_size) FILTER (l) AS above, max(p_size) FILTER (NOT l) AS below
    FROM (SELECT p_brand, p_size, p_size > CASE WHEN p_brand < 'Brand#3' THEN 25 ELSE 0 END AS l FROM part) GROUP BY p_brand)
"""

_PLACED = "SELECT unnest(range(1, len(w) + 1)) AS place, round(unnest(w), 5) AS weight FROM fw"


def oracle_sql() -> dict[str, str]:
    cov = lambda a, b: f"covar_pop({a}, {b})"
    names = ("l_quantity", "l_discount", "l_tax")
    cells = ", ".join(f"{cov(names[i], names[j])} AS c{i}{j}" for i in range(3) for j in range(i, 3))
    rights = ", ".join(f"{cov(n, 'l_extendedprice')} AS r{i}" for i, n in enumerate(names))
    det = "(c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02))"
    return {
        "ols_simple": "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r_squared, count(*) AS n_samples FROM lineitem",
        "ols_no_intercept": "WITH b AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b, var_pop(l_extendedprice) * count(*) AS s FROM lineitem) "
        "SELECT round(any_value(b), 6) AS slope, round(1 - sum((l_extendedprice - b * l_quantity) ** 2) / any_value(s), 8) AS r_squared FROM lineitem, b",
        "ols_multi": f"""
WITH m AS (SELECT {cells}, {rights}, avg(l_quantity) AS m0, avg(l_discount) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my, var_pop(l_extendedprice) AS vy FROM lineitem),
b AS (SELECT *,
    (r0 * (c11 * c22 - c12 * c12) - c01 * (r1 * c22 - c12 * r2) + c02 * (r1 * c12 - c11 * r2)) / {det} AS b0,
    (c00 * (r1 * c22 - c12 * r2) - r0 * (c01 * c22 - c12 * c02) + c02 * (c01 * r2 - r1 * c02)) / {det} AS b1,
    (c00 * (c11 * r2 - r1 * c12) - c01 * (c01 * r2 - r1 * c02) + r0 * (c01 * c12 - c11 * c02)) / {det} AS b2 FROM m)
SELECT round(b0, 5) AS b_quantity, round(b1, 3) AS b_discount, round(b2, 3) AS b_tax, round(my - b0 * m0 - b1 * m1 - b2 * m2, 3) AS intercept, round((b0 * r0 + b1 * r1 + b2 * r2) / vy, 8) AS r_squared FROM b""",
        "ols_grouped": "SELECT l_returnflag, count(*) AS n_samples, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r_squared FROM lineitem GROUP BY l_returnflag",
        "hc3_grouped": """
WITH a AS (
    SELECT l_returnflag, sxx / d AS a00, -sx / d AS a01, n / d AS a11, sy, sxy
    FROM (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_quantity ** 2) AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy, count(*)::DOUBLE * sum(l_quantity ** 2) - sum(l_quantity) ** 2 AS d FROM lineitem GROUP BY 1)
),
r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice - (a00 * sy + a01 * sxy) - (a01 * sy + a11 * sxy) * l_quantity AS e, a00 + 2 * a01 * l_quantity + a11 * l_quantity ** 2 AS h, a00, a01, a11 FROM lineitem JOIN a USING (l_returnflag)),
k AS (SELECT l_returnflag, any_value(a00) AS a00, any_value(a01) AS a01, any_value(a11) AS a11, sum(w) AS m00, sum(w * x) AS m01, sum(w * x * x) AS m11 FROM (SELECT *, e * e / ((1 - h) * (1 - h)) AS w FROM r) GROUP BY 1)
SELECT l_returnflag, round(sqrt(a01 * a01 * m00 + 2 * a01 * a11 * m01 + a11 * a11 * m11), 5) AS se_slope, round(sqrt(a00 * a00 * m00 + 2 * a00 * a01 * m01 + a01 * a01 * m11), 4) AS se_intercept FROM k""",
        "ols_transformed": "WITH s AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS d FROM lineitem), t AS (SELECT (l_quantity - a) / d AS z, ln(l_extendedprice) AS y FROM lineitem, s WHERE abs((l_quantity - a) / d) < 1.5) "
        "SELECT round(regr_slope(y, z), 8) AS slope, round(regr_intercept(y, z), 7) AS intercept, count(*) AS n_samples FROM t",
        "hc3_simple": _hc3(_ROWS, (5, 6), ("se_intercept", "se_slope")),
        "hc3_no_intercept": "WITH m AS (SELECT sum(l_quantity ** 2) AS sxx, sum(l_quantity * l_extendedprice) / sum(l_quantity ** 2) AS b FROM lineitem), "
        "r AS (SELECT l_quantity AS x, l_extendedprice - b * l_quantity AS e, l_quantity ** 2 / sxx AS h, sxx FROM lineitem, m) SELECT round(sqrt(sum(x * x * e * e / ((1 - h) * (1 - h)))) / any_value(sxx), 6) AS se_slope FROM r",
        "leverage_stats": _ROWS + "SELECT round(max(h), 10) AS max_leverage, round(sum(h), 6) AS sum_leverage FROM r",
        "cluster_scores": _SCORES + "SELECT g AS l_suppkey, n, round(s0, 2) AS s0, round(s1, 1) AS s1 FROM s",
        "cluster_sizes": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey",
        "cluster_balance": "SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, max(n) > sum(n) // 2 AS imbalanced FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)",
        "cluster_se_analytical": _sandwich(_SCORES, (5, 6), ("se_intercept", "se_slope"), ", gs AS n_clusters"),
        "wild_bootstrap_rademacher": _bootstrap_sql(_SCORES, _RADEMACHER, (5, 6), ("se_intercept", "se_slope"), ", (SELECT count(*) FROM s) AS n_clusters"),
        "wild_bootstrap_webb": _bootstrap_sql(_SCORES, _WEBB, (5, 6), ("se_intercept", "se_slope"), ", (SELECT count(*) FROM s) AS n_clusters"),
        "splitmix64_stream": f"WITH {_draws(SEED, 1000)} SELECT k, u::VARCHAR AS draw FROM u",
        "bootstrap_weights": f"WITH {_draws(SEED, 1000)} SELECT k, {_RADEMACHER} AS rademacher, round({_WEBB}, 9) AS webb FROM u",
        "logit_mle": _LOGIT + """
SELECT round(any_value(b0), 6) AS b0, round(any_value(b1), 6) AS b1, round(sum(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_likelihood,
    round(1 - sum(y * ln(p) + (1 - y) * ln(1 - p)) / (sum(y) * ln(avg(y)) + (count(*) - sum(y)) * ln(1 - avg(y))), 8) AS pseudo_r_squared, count(*) AS n_samples FROM p""",
        "logit_hc3": _hc3(_LOGIT, (6, 6), ("se0", "se1")),
        "logit_cluster_se": _sandwich(_LOGIT_SCORES, (6, 6), ("se0", "se1"), ", gs AS n_clusters"),
        "logit_score_bootstrap": _bootstrap_sql(_LOGIT_SCORES, _RADEMACHER, (6, 6), ("se0", "se1")),
        "logit_events": _LOGIT.replace("SELECT ln(n_chars) AS x, toxic::DOUBLE AS y, source AS g FROM labels JOIN documents USING (doc_id)", "SELECT value AS x, (event_type = 'purchase')::DOUBLE AS y, user_id AS g FROM events")
        + "SELECT round(any_value(b0), 6) AS b0, round(any_value(b1), 8) AS b1, round(sum(y * ln(p) + (1 - y) * ln(1 - p)), 3) AS log_likelihood, count(*) AS n_samples FROM p",
        "panel_detect": f"WITH {_SEGMENTS} SELECT 'unit' AS kind, unit AS key, max(treated) > 0 AS treated FROM c GROUP BY unit UNION ALL SELECT 'period', period::VARCHAR, max(treated) > 0 FROM c GROUP BY period",
        "panel_balance": f"WITH {_SEGMENTS} SELECT count(*) AS n_rows, count(DISTINCT unit) AS n_units, count(DISTINCT period) AS n_periods, count(*) = count(DISTINCT unit) * count(DISTINCT period) AS balanced FROM c",
        "panel_matrix": f"WITH {_SEGMENTS} SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY period) - 1)::INT AS place, y FROM c",
        "panel_gram": f"WITH {_SEGMENTS} SELECT a.unit AS unit_a, b.unit AS unit_b, round(sum(a.y * b.y), 4) AS product FROM c a JOIN c b USING (period) WHERE a.unit <= b.unit GROUP BY ALL",
        "sc_traditional": _control_sql("0"),
        "sc_robust": _control_sql("avg(y) OVER (PARTITION BY unit, tp)"),
        "sc_penalized": _penalized_sql("10.0::DOUBLE"),
        "sc_penalized_auto": _penalized_sql(_PENALTIES, ", penalty"),
        "sc_augmented": _AUGMENTED,
        "sc_placebo": _SC_PLACEBO,
        "sdid_placebo_se": _DID_PLACEBO,
        "logit_grouped": _LOGIT_GROUPED,
        "logit_separated": _SEPARATED,
        "wild_bootstrap_singletons": _bootstrap_sql(_SCORES.replace("l_quantity AS x, l_extendedprice AS y, l_suppkey AS g, l_returnflag AS f FROM lineitem", "s_nationkey AS x, s_acctbal AS y, s_suppkey AS g FROM supplier"), _RADEMACHER, (4, 5), ("se_intercept", "se_slope"), ", (SELECT count(*) FROM s) AS n_clusters"),
        "sdid_unit_weights": _DID_UNITS + _PLACED,
        "sdid_time_weights": _DID_TIMES + _PLACED,
        "sdid_att": _DID_EFFECT,
        "sdid_placebo_draws": "WITH " + _draws(SEED, DRAWS).replace("(k::UHUGEINT + 1) *", "k::UHUGEINT + 1::UHUGEINT *") + " SELECT k AS iteration, (u % 4)::BIGINT AS place FROM u",
        "simplex_projection": """
WITH v AS (SELECT p_brand, round(avg(p_size) - 50, 6) AS v FROM part GROUP BY p_brand),
r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k, sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) - 1 AS s FROM v),
l AS (SELECT s / k AS theta FROM r WHERE v - s / k > 0 ORDER BY k DESC LIMIT 1)
SELECT p_brand, round(greatest(v - theta, 0), 6) AS weight FROM v, l""",
        "windowed_ols": """
SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, event_type, count(*) AS n_samples, round(regr_slope(value, user_id), 7) AS slope, round(regr_intercept(value, user_id), 4) AS intercept
FROM events GROUP BY 1, 2""",
    }
