"""The estimators against dense NumPy versions, known values, and what they refuse."""

import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lodestar
from lodestar.functions import linalg, rng, simplex
from lodestar.operators import sdid, synthetic_control
from lodestar.operators.logistic import null_likelihood
from lodestar.plans import moments
from lodestar.plans import panel as panels

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")


def frame(spark, **columns):
    """A frame of the columns; numbers are doubles if any of the column is one."""
    values = {n: c.tolist() if isinstance(c, np.ndarray) else list(c) for n, c in columns.items()}
    kinds = {float: "double", int: "bigint", str: "string"}
    typed = {n: float if any(isinstance(x, float) for x in c) else type(c[0]) for n, c in values.items()}
    rows = zip(*[[None if x is None else typed[n](x) for x in c] for n, c in values.items()], strict=True)
    return spark.createDataFrame(list(rows), ", ".join(f"{n} {kinds[t]}" for n, t in typed.items())).repartition(3)


def dense(x, y, intercept=True):
    """Coefficients, residuals, inverse Gram matrix, design and leverages."""
    z = np.column_stack([np.ones(len(y)), x]) if intercept else np.asarray(x).reshape(len(y), -1)
    a = np.linalg.inv(z.T @ z)
    b = a @ z.T @ y
    return b, y - z @ b, a, z, np.einsum("ij,jk,ik->i", z, a, z)


def hc3(e, a, z, h):
    return np.sqrt(np.diag(a @ (z.T * (e / (1 - h)) ** 2) @ z @ a))


# Linear regression


def test_exact_line(spark):
    r = lodestar.linear_regression(frame(spark, x=[1.0, 2, 3, 4, 5], y=[2.0, 4, 6, 8, 10]), "x", "y")
    assert r.slope == pytest.approx(2, abs=1e-10) and r.intercept == pytest.approx(0, abs=1e-9) and r.r_squared == pytest.approx(1) and r.n_samples == 5


def test_known_errors(spark):
    r = lodestar.linear_regression(frame(spark, x=[1, 2, 3, 4, 5], y=[2.1, 3.9, 6.2, 7.8, 10.1]), "x", "y")
    assert (r.slope, r.standard_errors[0], r.intercept, r.intercept_se) == pytest.approx((1.99, 0.06815349, 0.05, 0.18959812), abs=1e-7)
    assert str(r).startswith("y = 1.990000 ± 0.068153x + 0.050000 (R² = ") and repr(r).startswith("LinearRegressionResult(coefficients=[")
    assert r.to_df(spark).first()["coefficients"] == r.coefficients


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("p", [1, 2, 7])
def test_hc3_against_dense(spark, p, intercept):
    g = np.random.default_rng(p)
    x = g.normal(size=(120, p))
    y = x @ np.arange(1, p + 1) + 1 + 0.5 * g.normal(size=120) * (1 + np.abs(x[:, 0]))
    names = [f"v{k}" for k in range(p)]
    r = lodestar.linear_regression(frame(spark, **dict(zip(names, x.T, strict=True)), y=y), names, "y", include_intercept=intercept)
    b, e, a, z, h = dense(x, y, intercept)
    got = ([r.intercept] if intercept else []) + r.coefficients
    errors = ([r.intercept_se] if intercept else []) + r.standard_errors
    assert np.allclose(got, b, rtol=1e-9) and np.allclose(errors, hc3(e, a, z, h), rtol=1e-9)
    assert r.r_squared == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum()) and (r.slope is None) == (p > 1)
    assert (r.intercept is None) != intercept


def test_both_ways_to_the_sums_agree(spark, monkeypatch):
    g = np.random.default_rng(3)
    df = frame(spark, a=g.normal(size=60), b=g.normal(size=60), y=g.normal(size=60), d=(g.uniform(size=60) < 0.4).astype(float))
    native = [lodestar.linear_regression(df, ["a", "b"], "y"), lodestar.logistic_regression(df, ["a", "b"], "d")]
    monkeypatch.setattr(moments, "NATIVE_COLUMNS", 0)
    blocks = [lodestar.linear_regression(df, ["a", "b"], "y"), lodestar.logistic_regression(df, ["a", "b"], "d")]
    for n, b in zip(native, blocks, strict=True):
        assert np.allclose(n.coefficients, b.coefficients, rtol=1e-9) and np.allclose(n.standard_errors, b.standard_errors, rtol=1e-9)


def test_constant_outcome_and_duplicates(spark):
    r = lodestar.linear_regression(frame(spark, x=[1.0, 2, 3, 4], y=[5.0] * 4), "x", "y")
    assert r.slope == pytest.approx(0, abs=1e-12) and r.intercept == pytest.approx(5)
    one = frame(spark, x=[1.0, 2, 3, 5], y=[2.0, 3, 5, 4])
    assert lodestar.linear_regression(one.union(one), "x", "y").slope == pytest.approx(lodestar.linear_regression(one, "x", "y").slope)


@pytest.mark.parametrize(
    "columns, message",
    [
        ({"x": [1.0], "y": [1.0]}, "at least"),
        ({"x": [1.0, 2.0], "y": [1.0, 2.5]}, "leverage"),
        ({"x": [5.0] * 4, "y": [1.0, 2, 3, 4]}, "(?i)singular"),
        ({"x": [0.0, 0, 0, 0, 10], "y": [1.0, 2, 3, 4, 5]}, "leverage"),
        ({"x": [1.0, float("nan"), 3, 4], "y": [1.0, 2, 3, 5]}, "(?i)singular"),
        ({"x": [1.0, None, 3, 4], "y": [1.0, 2, 3, 5]}, "(?i)singular"),
        ({"x": [1.0, 2, 3, 4], "y": [1.0, float("nan"), 3, 5]}, "NaN"),
    ],
)
def test_refused_rows(spark, columns, message):
    with pytest.raises(ValueError, match=message):
        lodestar.linear_regression(frame(spark, **columns), "x", "y")


def test_refused_arguments(spark):
    df = frame(spark, x=[1.0, 2, 3, 4], y=[1.0, 2, 3, 5], g=[1, 1, 2, 2], s=["a"] * 4)
    fit = lodestar.linear_regression
    for how, message in [
        (dict(x_cols=[]), "at least one"),
        (dict(bootstrap=True), "requires cluster"),
        (dict(bootstrap_iterations=0), "at least 1"),
        (dict(bootstrap_method="x"), "rademacher"),
        (dict(bootstrap_method="webb"), "requires bootstrap"),
        (dict(y_col="y\n"), "invalid characters"),
        (dict(y_col="z"), "not found"),
        (dict(y_col="s"), "numeric"),
    ]:
        with pytest.raises(ValueError, match=message):
            fit(df, **({"x_cols": "x", "y_col": "y"} | how))
    with pytest.raises(ValueError, match="empty"):
        fit(df.limit(0), "x", "y")


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.floats(-100, 100), st.floats(-100, 100))
def test_lines_are_recovered(spark, seed, slope, intercept):
    x = np.random.default_rng(seed).uniform(-100, 100, 40)
    r = lodestar.linear_regression(frame(spark, x=x, y=slope * x + intercept), "x", "y")
    assert r.slope == pytest.approx(slope, abs=1e-7) and r.intercept == pytest.approx(intercept, abs=1e-6)


def test_groups(spark):
    g = np.random.default_rng(8)
    k, x = np.repeat(["a", "b", "c"], [50, 30, 1]), g.normal(size=81)
    y = 2 * x + g.normal(size=81)
    rows = {r["k"]: r for r in lodestar.linear_regression_by(frame(spark, k=k, x=x, y=y), "k", "x", "y").collect()}
    for name in "ab":
        b, e, a, z, h = dense(x[k == name], y[k == name])
        assert rows[name]["coefficients"] == pytest.approx([b[1]]) and rows[name]["intercept"] == pytest.approx(b[0])
        assert [rows[name]["intercept_se"], *rows[name]["standard_errors"]] == pytest.approx(hc3(e, a, z, h).tolist())
    assert rows["c"]["coefficients"] is None and "Not enough" in rows["c"]["error"]


# Clusters


@pytest.fixture(scope="module")
def grouped():
    g = np.random.default_rng(11)
    k = np.repeat(np.arange(12), 20)
    x = g.normal(size=240)
    return k, x, 1 + 2 * x + g.normal(size=12)[k] + 0.5 * g.normal(size=240)


def test_clustered_against_dense(spark, grouped):
    k, x, y = grouped
    b, e, a, z, _ = dense(x, y)
    s = np.array([(z * e[:, None])[k == c].sum(axis=0) for c in range(12)])
    want = np.sqrt(np.diag(12 / 11 * 239 / 238 * a @ s.T @ s @ a))
    for cluster in (k, np.array([f"c{c:02d}" for c in k])):
        r = lodestar.linear_regression(frame(spark, x=x, y=y, g=cluster), "x", "y", cluster="g")
        assert [r.intercept_se, *r.standard_errors] == pytest.approx(want.tolist(), rel=1e-9) and (r.n_clusters, r.cluster_se_type) == (12, "analytical")


@pytest.mark.parametrize("method", ["rademacher", "webb"])
def test_bootstrap_against_refits(spark, grouped, method):
    k, x, y = grouped
    b, e, a, z, _ = dense(x, y)
    w = rng.weights(method, 42, np.arange(50 * 12)).reshape(50, 12)
    refits = np.array([a @ z.T @ (z @ b + w[n][k] * e) for n in range(50)])
    r = lodestar.linear_regression(frame(spark, x=x, y=y, g=k), "x", "y", cluster="g", bootstrap=True, bootstrap_iterations=50, seed=42, bootstrap_method=method.upper())
    assert [r.intercept_se, *r.standard_errors] == pytest.approx(refits.std(axis=0, ddof=1).tolist(), rel=1e-9)
    assert (r.cluster_se_type, r.bootstrap_iterations_used) == (f"bootstrap_{method}", 50)
    one = lodestar.linear_regression(frame(spark, x=x, y=y, g=k), "x", "y", cluster="g", bootstrap=True, bootstrap_iterations=1, seed=1)
    assert one.standard_errors == [0.0]


def test_cluster_faults_and_advice(spark):
    x, y = np.arange(10.0), np.array([1.0, 3, 2, 5, 4, 7, 5, 8, 9, 8])
    fit = lambda g, **how: lodestar.linear_regression(frame(spark, x=x, y=y, g=g), "x", "y", cluster="g", **how)
    with pytest.raises(ValueError, match="null"):
        fit([1, None] + [2] * 8)
    with pytest.raises(ValueError, match="at least 2 clusters"):
        fit([1] * 10)
    with pytest.raises(ValueError, match="only 1 observation"):
        fit(list(range(10)))
    assert fit(list(range(10)), bootstrap=True, bootstrap_iterations=20, seed=1).n_clusters == 10
    with pytest.raises(ValueError, match="not found"):
        lodestar.linear_regression(frame(spark, x=x, y=y), "x", "y", cluster="g")
    with pytest.raises(ValueError, match="nearly singular"):
        lodestar.linear_regression(frame(spark, x=x, y=0 * x, g=[1, 1, 2, 2, 3, 3, 4, 4, 5, 5]), "x", "y", cluster="g")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        r = fit([1.0] * 7 + [2.0] * 3)
    said = " ".join(str(w.message) for w in told)
    assert "float" in said and "70% of observations" in said and "2 clusters" in said and len(r.warnings) == 3


def test_generator():
    assert int(rng.draws(42, np.array([0]))[0]) == 13679457532755275413
    state, mask = 42, (1 << 64) - 1
    for k in range(50):
        state = (state + rng.GAMMA) & mask
        z = state
        z = ((z ^ z >> 30) * rng.MIX_1) & mask
        z = ((z ^ z >> 27) * rng.MIX_2) & mask
        assert int(rng.draws(42, np.array([k]))[0]) == z ^ z >> 31
    w = rng.weights("webb", 1, np.arange(60_000))
    assert (w**2).mean() == pytest.approx(13 / 18, abs=0.01) and (rng.weights("webb_published", 1, np.arange(60_000)) ** 2).mean() == pytest.approx(1, abs=0.02)


# Logistic regression


def newton(x, d):
    z = np.column_stack([np.ones(len(d)), x])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        a = np.linalg.inv(z.T * (p * (1 - p)) @ z)
        b = b + a @ z.T @ (d - p)
    return b, p, a, z


def test_logistic_against_dense(spark):
    g = np.random.default_rng(42)
    x = g.normal(size=200)
    d = (g.uniform(size=200) < 1 / (1 + np.exp(-0.5 - x))).astype(float)
    k = np.arange(200) % 10
    df = frame(spark, x=x, d=d, g=k)
    b, p, a, z = newton(x, d)
    r = lodestar.logistic_regression(df, "x", "d")
    h = p * (1 - p) * np.einsum("ij,jk,ik->i", z, a, z)
    assert [r.intercept, *r.coefficients] == pytest.approx(b.tolist(), rel=1e-8)
    assert [r.intercept_se, *r.standard_errors] == pytest.approx(hc3(d - p, a, z, h).tolist(), rel=1e-7)
    ll = (d * np.log(p) + (1 - d) * np.log(1 - p)).sum()
    assert r.log_likelihood == pytest.approx(ll) and r.pseudo_r_squared == pytest.approx(1 - ll / null_likelihood(200, d.sum())) and r.converged and 3 < r.iterations < 10
    s = np.array([(z * (d - p)[:, None])[k == c].sum(axis=0) for c in range(10)])
    want = np.sqrt(np.diag(10 / 9 * 199 / 198 * a @ s.T @ s @ a))
    c = lodestar.logistic_regression(df, "x", "d", cluster="g")
    assert [c.intercept_se, *c.standard_errors] == pytest.approx(want.tolist(), rel=1e-7)
    w = rng.weights("rademacher", 7, np.arange(30 * 10)).reshape(30, 10)
    c = lodestar.logistic_regression(df, "x", "d", cluster="g", bootstrap=True, bootstrap_iterations=30, seed=7)
    assert [c.intercept_se, *c.standard_errors] == pytest.approx((w @ s @ a).std(axis=0, ddof=1).tolist(), rel=1e-7)
    assert "logit" in str(c) and c.to_df(spark).count() == 1


@pytest.mark.parametrize("d, message", [([0.0, 0, 0, 1, 1, 1], "Perfect separation"), ([0.0, 1, 2, 0, 1, 0], "0 and 1"), ([1.0] * 6, "both 0 and 1"), ([0.0, 1, None, 0, 1, 0], "0 and 1")])
def test_logistic_refuses(spark, d, message):
    with pytest.raises(ValueError, match=message):
        lodestar.logistic_regression(frame(spark, x=[1.0, 2, 3, 4, 5, 6], d=d), "x", "d")


# Simplex


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=12))
def test_projection(values):
    v = np.array(values)
    w = simplex.project(v)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    for k in range(len(v)):  # no vertex is in a better direction
        assert (v - w) @ (np.eye(len(v))[k] - w) <= 1e-6


def test_frank_wolfe_finds_mixtures():
    g = np.random.default_rng(2)
    y = g.normal(size=(6, 40))
    w = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    found = simplex.frank_wolfe(y @ y.T, y @ (w @ y), max_iter=20_000, tol=1e-4)
    assert np.allclose(found.weights, w, atol=0.02) and found.weights.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        simplex.solved(np.ones((2, 2)), np.ones(2))
    m = g.normal(size=(5, 5))
    assert np.allclose(simplex.solved(m, np.arange(5.0)), np.linalg.solve(m, np.arange(5.0)))


# Panels


def panel(spark, y, treated, post, text=False):
    """A long panel; ``treated`` units from period ``post`` on."""
    rows = [(f"u{u}" if text else u, f"t{t:02d}" if text else t, float(v), int(u in treated and t >= post)) for u, line in enumerate(y) for t, v in enumerate(line)]
    kind = "string" if text else "bigint"
    return spark.createDataFrame(rows, f"unit {kind}, time {kind}, y double, d int").repartition(3)


ARGS = ("unit", "time", "y", "d")


def simple_panel():
    y = np.array([[1 + 0.5 * u + t for t in range(6)] for u in range(6)])
    y[0, 4:] += 5
    return y


def test_control_known_values(spark):
    r = lodestar.synthetic_control(panel(spark, simple_panel(), {0}, 4), *ARGS)
    assert r.att == pytest.approx(4.5) and r.unit_weights == pytest.approx([1, 0, 0, 0, 0]) and r.pre_treatment_rmse == pytest.approx(0.5)
    assert (r.n_units_control, r.n_periods_pre, r.n_periods_post, r.n_placebo_used, r.n_failed_iterations, r.lambda_used) == (5, 4, 2, 5, 0, None)
    assert r.standard_error > 0 and "traditional" in str(r) and len(r.to_df(spark).columns) == 16
    text = lodestar.synthetic_control(panel(spark, simple_panel(), {0}, 4, text=True), *ARGS, method="ROBUST", compute_se=False)
    assert text.method == "robust" and text.standard_error is None and sum(text.unit_weights) == pytest.approx(1)


@pytest.mark.parametrize("method", synthetic_control.METHODS)
def test_control_methods(spark, method):
    g = np.random.default_rng(42)
    y = 10 + g.uniform(-1, 1, (11, 12)) + 0.5 * np.arange(12)
    y[0, 8:] += 5
    r = lodestar.synthetic_control(panel(spark, y, {0}, 8), *ARGS, method=method)
    v = synthetic_control.view(y, np.arange(1, 11), 0, np.arange(8), np.arange(8, 12))
    assert min(r.unit_weights) >= 0 and sum(r.unit_weights) == pytest.approx(1) and abs(r.att - 5) < 2
    w = np.array(r.unit_weights)
    adjusted = synthetic_control.bias(v, w, 1.0) if method == "augmented" else 0.0
    assert r.att == pytest.approx(v.effect(w) - adjusted) and r.pre_treatment_mse == pytest.approx(v.fit(w))
    effects = []
    for k in range(1, 11):
        others = np.delete(np.arange(1, 11), k - 1)
        p = synthetic_control.view(y, others, k, np.arange(8), np.arange(8, 12))
        effects.append(p.effect(synthetic_control.weights(p, method, None, 1000, 1e-6)))
    assert r.standard_error == pytest.approx(np.std(effects, ddof=1)) and r.n_placebo_used == 10
    few = lodestar.synthetic_control(panel(spark, y, {0}, 8), *ARGS, method=method, n_placebo=1)
    assert few.standard_error is None


def did_panel(seed=5):
    g = np.random.default_rng(seed)
    y = 1 + 0.1 * np.arange(10)[:, None] + np.arange(7) + 0.3 * g.normal(size=(10, 7))
    y[[0, 9], 5:] += 10
    return y


def test_did_effect_and_placebos(spark):
    y = did_panel()
    r = lodestar.synthetic_did(panel(spark, y, {0, 9}, 5), *ARGS, bootstrap_iterations=40, seed=42)
    assert abs(r.att - 10) < 1 and sum(r.unit_weights) == pytest.approx(1) and sum(r.time_weights) == pytest.approx(1)
    control, pre, post = np.arange(1, 9), np.arange(5), np.arange(5, 7)
    drawn = [int(rng.draws(42 + k, np.array([0]))[0] % 8) for k in range(40)]
    assert sdid.placebo_units(42, 40, 8).tolist() == drawn
    effects = [sdid.solve(y, np.delete(control, k), np.array([0, 9, control[k]]), pre, post)[0] for k in drawn]
    assert r.standard_error == pytest.approx(np.std(effects, ddof=1)) and r.bootstrap_iterations_used == 40
    again = lodestar.synthetic_did(panel(spark, y, {0, 9}, 5, text=True), *ARGS, bootstrap_iterations=40, seed=42)
    assert again.standard_error == pytest.approx(r.standard_error) and again.att == pytest.approx(r.att)
    none = lodestar.synthetic_did(panel(spark, y, {0, 9}, 5), *ARGS, bootstrap_iterations=0)
    assert (none.standard_error, none.bootstrap_iterations_used) == (0.0, 0) and any("less than 100" in w for w in none.warnings)
    assert "SDID" in str(none) and none.to_df(spark).first()["solver_iterations"]["unit"] == 200


@pytest.fixture()
def tall_panels(monkeypatch):
    """Every panel stays distributed."""
    monkeypatch.setattr(panels, "MOST_CELLS", 1)


@pytest.mark.parametrize("pure", [False, True])
def test_did_of_a_tall_panel(spark, tall_panels, monkeypatch, pure):
    monkeypatch.setattr(sdid, "MOST_STEPS", 8)
    y = did_panel()
    r = lodestar.synthetic_did(panel(spark, y, {0, 9}, 5, text=True), *ARGS, bootstrap_iterations=12, seed=42, pure_placebo=pure)
    control, treated, pre, post = np.arange(1, 9), np.array([0, 9]), np.arange(5), np.arange(5, 7)
    effect, units, times = sdid.solve(y, control, treated, pre, post)
    assert r.att == pytest.approx(effect) and r.unit_weights == pytest.approx(units.weights) and r.time_weights == pytest.approx(times.weights)
    assert (r.n_units_control, r.n_units_treated, r.n_periods_pre, r.n_periods_post) == (8, 2, 5, 2)
    effects = []
    for k in sdid.placebo_units(42, 12, 8).tolist():
        own = control[k : k + 1] if pure else np.append(treated, control[k])
        effects.append(sdid.solve(y, np.delete(control, k), own, pre, post)[0])
    assert r.standard_error == pytest.approx(np.std(effects, ddof=1)) and r.bootstrap_iterations_used == 12


@pytest.mark.parametrize("method", ["traditional", "robust", "augmented"])
def test_control_of_a_tall_panel(spark, tall_panels, method):
    g = np.random.default_rng(42)
    y = 10 + g.uniform(-1, 1, (11, 12)) + 0.5 * np.arange(12)
    y[4, 8:] += 5
    r = lodestar.synthetic_control(panel(spark, y, {4}, 8), *ARGS, method=method, max_iter=8, n_placebo=4)
    control, pre, post = np.delete(np.arange(11), 4), np.arange(8), np.arange(8, 12)
    v = synthetic_control.view(y, control, 4, pre, post)
    w = synthetic_control.weights(v, method, None, 8, 1e-6)
    assert r.unit_weights == pytest.approx(w) and r.pre_treatment_mse == pytest.approx(v.fit(w))
    assert r.att == pytest.approx(v.effect(w) - (synthetic_control.bias(v, w, 1.0) if method == "augmented" else 0.0))
    effects = []
    for k in range(4):
        p = synthetic_control.view(y, np.delete(control, k), control[k], pre, post)
        effects.append(p.effect(synthetic_control.weights(p, method, None, 8, 1e-6)))
    assert r.standard_error == pytest.approx(np.std(effects, ddof=1)) and r.n_placebo_used == 4


def test_tall_panels_that_are_refused(spark, tall_panels, monkeypatch):
    with pytest.raises(ValueError, match="'penalized' takes panels of at most"):
        lodestar.synthetic_control(panel(spark, simple_panel(), {0}, 4), *ARGS, method="penalized")
    monkeypatch.setattr(panels, "MOST_PERIODS", 5)
    with pytest.raises(ValueError, match="and 6 periods"):
        lodestar.synthetic_did(panel(spark, simple_panel(), {0}, 4), *ARGS)


def test_panel_faults(spark):
    from pyspark.sql import functions as F

    good = panel(spark, simple_panel(), {0}, 4)
    both = (lodestar.synthetic_did, lodestar.synthetic_control)
    for df, message in [
        (good.limit(0), "empty"),
        (good.drop("y"), "not found"),
        (good.withColumn("unit", F.col("unit").cast("double")), "unit_col must be integer or string"),
        (good.withColumn("time", F.col("time").cast("float")), "time_col must be integer or string"),
        (good.withColumn("y", F.lit("a")), "numeric"),
        (good.withColumn("y", F.when(F.col("unit") != 2, F.col("y"))), "null"),
        (good.withColumn("d", F.lit(2)), "0 and 1"),
        (good.where("unit <> 2 or time <> 3"), "not balanced"),
        (good.where("unit <> 2 or time <> 3").union(good.where("unit = 1 and time = 1")), "not balanced"),
        (good.withColumn("d", F.lit(0)), "No treated"),
        (good.where("time >= 4"), "pre-treatment"),
    ]:
        for estimate in both:
            with pytest.raises(ValueError, match=message):
                estimate(df, *ARGS)
    with pytest.raises(ValueError, match="exactly 1 treated"):
        lodestar.synthetic_control(panel(spark, simple_panel(), {0, 1}, 4), *ARGS)
    with pytest.raises(ValueError, match="method must be"):
        lodestar.synthetic_control(good, *ARGS, method="other")
    with pytest.raises(ValueError, match="lambda_param"):
        lodestar.synthetic_control(good, *ARGS, lambda_param=-1.0)
    with pytest.raises(ValueError, match="at least 0"):
        lodestar.synthetic_did(good, *ARGS, bootstrap_iterations=-1)
    with pytest.raises(ValueError, match="2 control"):
        lodestar.synthetic_did(good.where("unit < 2"), *ARGS)


# Package


def test_package(capsys, spark, tmp_path):
    from lodestar.sources.tables import table, write_results

    lodestar.about()
    assert lodestar.__version__ in capsys.readouterr().out and all(hasattr(lodestar, n) for n in lodestar.__all__)
    r = lodestar.linear_regression(frame(spark, x=[1.0, 2, 3, 5], y=[2.0, 3, 5, 4]), "x", "y")
    write_results(spark, [r, r], str(tmp_path / "r.parquet"))
    assert table(spark, str(tmp_path), "r").count() == 2


def test_windowed_regression_on_a_stream(spark, tmp_path):
    from lodestar.streaming.ols import windowed_regression

    rows = spark.createDataFrame([(k, float(k % 7), 3.0 * (k % 7) + 1) for k in range(200)], "s bigint, x double, y double").selectExpr("timestamp_seconds(s) ts", "x", "y")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_regression(stream, "ts", "x", "y", "1 minute", watermark="10 seconds").writeStream.format("memory").queryName("windows").outputMode("update").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("select * from windows").collect()
    assert len(got) == 4 and sum(r["n_samples"] for r in got) == 200 and all(r["slope"] == pytest.approx(3) and r["intercept"] == pytest.approx(1) for r in got)


def test_plans_prune_columns(spark, tmp_path):
    from lodestar.plans.moments import Design

    path = str(tmp_path / "wide.parquet")
    spark.range(100).selectExpr("double(id) a", "double(id) b", "double(id * id) y").write.parquet(path)
    plan = Design(spark.read.parquet(path), ["a"], "y", True).rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:double,y:double>" in plan.replace("\n", "")


def test_linalg():
    m = np.array([[4.0, 1], [1, 3]])
    assert np.allclose(linalg.inverse(m), np.linalg.inv(m)) and np.allclose(linalg.unpacked(linalg.packed(m), 2), m)
    assert linalg.ill_conditioned(np.diag([1.0, 1e11])) and not linalg.ill_conditioned(m)


def test_logistic_groups(spark):
    g = np.random.default_rng(6)
    k = np.repeat(["a", "b", "c", "d"], [150, 200, 40, 6])
    x = g.normal(size=396)
    d = (g.uniform(size=396) < 1 / (1 + np.exp(-x * (1 + (k == "b"))))).astype(float)
    d[k == "c"] = 1.0
    x[k == "d"], d[k == "d"] = [1, 2, 3, 4, 5, 6], [0, 0, 0, 1, 1, 1]
    df = frame(spark, k=k, x=x, d=d)
    rows = {r["k"]: r for r in lodestar.logistic_regression_by(df, "k", "x", "d").collect()}
    for name in "ab":
        want = lodestar.logistic_regression(df.where(df["k"] == name), "x", "d")
        got = rows[name]
        assert [got["intercept"], *got["coefficients"]] == pytest.approx([want.intercept, *want.coefficients], rel=1e-8)
        assert [got["intercept_se"], *got["standard_errors"]] == pytest.approx([want.intercept_se, *want.standard_errors], rel=1e-6)
        assert (got["n_samples"], got["iterations"]) == (want.n_samples, want.iterations) and got["pseudo_r_squared"] == pytest.approx(want.pseudo_r_squared)
    assert "both 0 and 1" in rows["c"]["error"] and rows["c"]["coefficients"] is None and "separation" in rows["d"]["error"]


def test_logistic_ends_at_rounding_errors(spark):
    """Covariates 2^30 times as large scale the gradient and its rounding errors, beyond any fixed limit; the fit is the same."""
    g = np.random.default_rng(9)
    k, x, scale = np.repeat(["a", "b"], 200), g.normal(size=400), 2.0**30
    d = (g.uniform(size=400) < 1 / (1 + np.exp(-x))).astype(float)
    df = frame(spark, k=k, x=x, z=x * scale, d=d)
    want, got = (lodestar.logistic_regression(df, c, "d", include_intercept=False) for c in "xz")
    assert [got.coefficients[0] * scale, got.standard_errors[0] * scale, got.log_likelihood] == pytest.approx([want.coefficients[0], want.standard_errors[0], want.log_likelihood], rel=1e-9)
    assert got.iterations <= want.iterations + 2
    plain, large = ({r["k"]: r for r in lodestar.logistic_regression_by(df, "k", c, "d", include_intercept=False).collect()} for c in "xz")
    for name in "ab":
        assert plain[name]["error"] is None and large[name]["error"] is None
        assert [v * scale for v in (*large[name]["coefficients"], *large[name]["standard_errors"])] == pytest.approx([*plain[name]["coefficients"], *plain[name]["standard_errors"]], rel=1e-9)
        assert large[name]["iterations"] <= plain[name]["iterations"] + 2


def test_rows_that_drift_apart_are_no_fit(spark):
    """Where one level of a covariate has one outcome only, steps get short as weights vanish."""
    g = np.random.default_rng(4)
    x = np.repeat([0.0, 1e4], [60, 5])
    d = np.where(x > 0, 1.0, g.integers(0, 2, 65))
    with pytest.raises(ValueError, match="Convergence failed"):
        lodestar.logistic_regression(frame(spark, x=x, d=d), "x", "d")
    (row,) = lodestar.logistic_regression_by(frame(spark, k=["a"] * 65, x=x, d=d), "k", "x", "d").collect()
    assert "Convergence failed" in row["error"] and row["coefficients"] is None


@pytest.mark.parametrize(("lower", "before", "length", "halvings", "ends"), [(1.5e-6, 1e-8, 1e-14, 0, False), (1.5e-6, 1e-13, 1e-19, 0, True), (1.5e-6, 1e-15, 1e-15, 0, True), (1.0, 1e-8, 1e-14, 1, False)])
def test_steps_of_many_rows_end_at_rounding_errors(lower, before, length, halvings, ends):
    """Values of 9 million rows: a likelihood that is lower in its last digits, the last and the next step's squared lengths in standard errors."""
    from lodestar.operators.logistic_by import _advance

    state = {"n": 9039600, "ones": 1.8e6, "reach": [1.0], "beta": [-1.36], "likelihood": -4508846.125020924, "gradient": [before / 1e-7], "info": [1.4e6], "candidate": [-1.3599999], "direction": [1e-7], "step": 1.0, "halvings": 0, "steps": 5, "error": None}
    row = state | {"new_likelihood": state["likelihood"] - lower, "inside": 9039600, "new_gradient": [float(np.sqrt(length * 1.4e6))], "new_info": [1.4e6]}
    after = _advance(row, 1)
    assert (after["halvings"], after["direction"] is None, after["error"]) == (halvings, ends, None)


# Plans


def test_positions_number_all_rows_in_order(spark):
    from lodestar.plans.stored import Scratch, positions

    values = [(k * 7919) % 1000 for k in range(1000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    with Scratch(spark, "test") as scratch:
        got = positions(df, [df["v"].asc_nulls_last()], scratch, "rows").collect()
        none = positions(df.limit(0), [df["v"].asc_nulls_last()], scratch, "none").collect()
    assert none == [] and sorted((r["position"], r["v"]) for r in got) == [(k, k) for k in range(1000)] + [(1000, None)]


def test_bootstrap_of_many_clusters_equals_plain_draws(spark):
    from lodestar.functions import rng

    g = np.random.default_rng(5)
    n, clusters, draws = 6000, 5000, 50
    x, cluster = g.normal(size=n), g.permutation(np.arange(n) % clusters)
    y = 1 + 2 * x + g.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), f"c{k:06}") for a, b, k in zip(x, y, cluster, strict=True)], "x double, y double, g string").repartition(6)
    r = lodestar.linear_regression(df, "x", "y", cluster="g", bootstrap=True, bootstrap_iterations=draws, seed=3)
    design = np.column_stack([np.ones(n), x])
    bread = np.linalg.inv(design.T @ design)
    scores = np.zeros((clusters, 2))
    np.add.at(scores, cluster, design * (y - design @ (bread @ design.T @ y))[:, None])
    weights = rng.weights("rademacher", 3, np.arange(draws * clusters)).reshape(draws, clusters)
    want = (weights @ scores @ bread).std(axis=0, ddof=1)
    assert [r.intercept_se, *r.standard_errors] == pytest.approx(want.tolist(), rel=1e-9)


def test_rows_of_groups_are_not_shuffled(spark):
    """Coefficients are a small stored table, so even a low threshold broadcasts them to the rows."""
    df = spark.range(20_000).selectExpr("id % 3 AS g", "double(id % 17) AS x", "double(id % 17 * 2 + id % 5) AS y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 << 20))
    try:
        result = lodestar.linear_regression_by(df, "g", "x", "y")
        assert len(result.collect()) == 3
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
