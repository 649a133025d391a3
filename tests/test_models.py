import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmarts.operators import effects as E
from tripmarts.operators import linear as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 240
    x, z, g, t = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n), np.arange(n)
    c = rng.integers(0, 12, n)
    y = 1 + 2 * x - z + 0.5 * g + rng.normal(size=n) * (1 + np.abs(x))
    pdf = {"x": x, "z": z, "g": g, "t": t, "c": c, "y": y}
    df = spark.createDataFrame([tuple(float(pdf[k][i]) if k in "xzy" else int(pdf[k][i]) for k in pdf) for i in range(n)], "x double, z double, g int, t int, c int, y double").repartition(5)
    X = np.column_stack([np.ones(n), x, z] + [(g == k).astype(float) for k in (1, 2, 3)])
    return df, X, y, pdf


def _reference(X, y):
    b = np.linalg.solve(X.T @ X, X.T @ y)
    return b, y - X @ b, np.linalg.inv(X.T @ X)


def test_ols_covariances(data):
    df, X, y, raw = data
    b, e, inv = _reference(X, y)
    n, k = X.shape
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    want = {"nonrobust": inv * (e @ e) / (n - k), "HC3": inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv}
    s = X * e[:, None]
    meat = s.T @ s
    for lag in (1, 2, 3):
        gam = s[lag:].T @ s[:-lag]
        meat = meat + (1 - lag / 4) * (gam + gam.T)
    want["HAC"] = inv @ meat @ inv
    groups = [s[raw["c"] == c].sum(0) for c in np.unique(raw["c"])]
    m = sum(np.outer(v, v) for v in groups)
    want["cluster"] = inv @ m @ inv * len(groups) / (len(groups) - 1) * (n - 1) / (n - k)
    for cov, v in want.items():
        f = L.fit(df, "y", ["x", "z"], ["g"], cov=cov, cluster="c" if cov == "cluster" else None, order="t" if cov == "HAC" else None)["all"]
        assert np.allclose(f.beta, b) and np.allclose(np.diag(f.cov), np.diag(v)), cov
        assert f.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_grouped_and_exact_fit(spark):
    rows = [("a", float(i), 2 + 3.0 * i) for i in range(5)] + [("b", float(i), 1 - 1.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r["k"], r["term"]): r for r in L.ols(df, "y", ["x"], cov="HC3", by="k").collect()}
    assert got[("a", "const")]["coef"] == pytest.approx(2) and got[("a", "x")]["coef"] == pytest.approx(3) and got[("b", "x")]["coef"] == pytest.approx(-1)
    assert got[("a", "x")]["se"] == pytest.approx(0, abs=1e-6)


def test_interaction_wald_block(data):
    df, X, y, raw = data
    f = L.fit(df, "y", ["x"], ["g"], cov="HC3", interact=[("x", "g")])["all"]
    r = L.wald_block(df, f, "x:g=").first()
    g, x = raw["g"], raw["x"]
    X2 = np.column_stack([np.ones(len(y)), x] + [(g == k) * 1.0 for k in (1, 2, 3)] + [x * (g == k) for k in (1, 2, 3)])
    b, e, inv = _reference(X2, y)
    h = np.einsum("ij,jk,ik->i", X2, inv, X2)
    v = inv @ (X2.T * (e / (1 - h)) ** 2) @ X2 @ inv
    assert r["terms"] == 3 and r["chi2"] == pytest.approx(b[5:] @ np.linalg.solve(v[5:, 5:], b[5:]))


def test_binomial_matches_newton(spark):
    rng = np.random.default_rng(5)
    rows = []
    for z in range(6):
        for hi in (0.0, 1.0):
            n = int(rng.integers(50, 200))
            p = 1 / (1 + np.exp(-(-1 + 0.7 * hi + 0.2 * z)))
            rows.append((z, hi, int(rng.binomial(n, p)), n))
    df = spark.createDataFrame(rows, "z int, hi double, s int, n int")
    f = L.binomial(df, "s", "n", ["hi"], ["z"], cluster="z")
    a = np.array(rows, dtype=float)
    X = np.column_stack([np.ones(len(a)), a[:, 1]] + [(a[:, 0] == k) * 1.0 for k in range(1, 6)])
    b = np.zeros(X.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b))
        w = a[:, 3] * mu * (1 - mu)
        b = b + np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (a[:, 2] - a[:, 3] * mu))
    assert f.converged and np.allclose(f.beta, b, atol=1e-8)
    mu1, mu0 = (1 / (1 + np.exp(-(X @ b + b[1] * (v - X[:, 1])))) for v in (1, 0))
    assert L.marginal_difference(f, "hi", "n").first()[0] == pytest.approx(np.average(mu1 - mu0, weights=a[:, 3]))


def test_effects(data, spark):
    df, X, y, raw = data
    d = df.withColumn("key", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")))
    r = E.adjusted_effect(d, "x", "y", ["z"], ["g"], key="key", refute=("placebo", "random_cause", "subset"), cluster="c").first()
    b, e, inv = _reference(X, y)
    assert r["ate"] == pytest.approx(b[1]) and abs(r["placebo"]) < abs(r["ate"]) / 2 and r["subset80"] == pytest.approx(r["ate"], rel=.5)
    t = r["ate"] / r["se"]
    assert r["partial_r2"] == pytest.approx(t * t / (t * t + len(y) - X.shape[1]))
    shuffled = E._shuffle_column(d, "key", "x", 1).select("x").toPandas()["x"].sort_values().to_numpy()
    assert np.allclose(shuffled, np.sort(raw["x"]))


def test_dummy_fixed_effects_on_unbalanced_panel(spark):
    rng = np.random.default_rng(7)
    rows = [(u, t, float(rng.normal()), 0.0) for u in range(12) for t in range(6) if (u * 7 + t) % 5]
    rows = [(u, t, x, 1.5 * x + u - 2 * t + float(rng.normal())) for u, t, x, _ in rows]
    r = E.dummy_fixed_effects(spark.createDataFrame(rows, "u int, t int, x double, y double"), "u", "t", "x", "y").first()
    a = np.array(rows)
    X = np.column_stack([a[:, 2]] + [(a[:, 0] == u) * 1.0 for u in range(12)] + [(a[:, 1] == t) * 1.0 for t in range(1, 6)])
    b, e, inv = _reference(X, a[:, 3])
    assert r["ate"] == pytest.approx(b[0])
    df_resid = len(a) - X.shape[1]
    assert r["se"] == pytest.approx(np.sqrt(e @ e / df_resid * inv[0, 0]), rel=1e-6)


def test_lags_reach_over_block_borders(spark):
    """Two series, one shorter than a block, blocks shorter than some lags: every lagged product is found, none between series."""
    rng = np.random.default_rng(11)
    series = {"a": rng.normal(size=(53, 2)), "b": rng.normal(size=(6, 2)), "c": rng.normal(size=(2, 2))}
    rows = [(g, t, [float(x) for x in s]) for g, m in series.items() for t, s in enumerate(m)]
    df = spark.createDataFrame(rows, "grp string, t int, s array<double>").repartition(4)
    for lags, block in ((3, 7), (9, 4), (3, 1000)):
        got = L._outer(L.with_earlier(df, "t", lags, block), "s", "s_earlier")
        for g, m in series.items():
            want = sum((1 - k / (lags + 1)) * m[k:].T @ m[:-k] for k in range(1, lags + 1) if k < len(m))
            assert np.allclose(got[g], want)
