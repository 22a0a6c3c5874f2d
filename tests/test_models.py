import math

import numpy as np
import pytest

from notewise.functions.stats import t_ppf, two_sided_p
from notewise.operators.models import fit_lme, gram_by, lme_stats, reml_objective, ridge_solve


def _frame(spark, n_groups=25, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        u = rng.normal(scale=0.5)
        for _ in range(int(rng.integers(1, 9))):
            x1, x2 = rng.normal(), rng.normal()
            rows.append((str(g), 1.0, x1, x2, 1.0 + 0.5 * x1 - 0.2 * x2 + u + rng.normal()))
    return spark.createDataFrame(rows, "g string, one double, x1 double, x2 double, y double"), rows


def _dense_reml(rows, theta):
    X = np.array([[r[1], r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    groups = [r[0] for r in rows]
    n, p = X.shape
    Z = np.array([[1.0 if groups[i] == g else 0.0 for g in sorted(set(groups))] for i in range(n)])
    V = np.eye(n) + theta * Z @ Z.T
    Vi = np.linalg.inv(V)
    A = X.T @ Vi @ X
    beta = np.linalg.solve(A, X.T @ Vi @ y)
    r = y - X @ beta
    s2 = r @ Vi @ r / (n - p)
    return (n - p) * math.log(s2) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1], beta


def test_reml_matches_dense_computation(spark):
    df, rows = _frame(spark)
    st = lme_stats(df, "y", ["one", "x1", "x2"], "g", [])[()]
    for theta in (0.0, 0.1, 0.7, 3.0):
        want, _ = _dense_reml(rows, theta)
        assert reml_objective(st, theta) == pytest.approx(want, rel=1e-10)
    model = fit_lme(df, "y", ["one", "x1", "x2"], "g")
    grid = [(t, _dense_reml(rows, t)[0]) for t in np.exp(np.linspace(-8, 3, 400))]
    best = min(grid, key=lambda t: t[1])
    assert _dense_reml(rows, model.fit["theta"])[0] <= best[1] + 1e-6
    assert np.allclose(model.fit["beta"], _dense_reml(rows, model.fit["theta"])[1])


def test_fitted_uses_blups(spark):
    df, rows = _frame(spark, seed=1)
    model = fit_lme(df, "y", ["one", "x1", "x2"], "g")
    th, beta = model.fit["theta"], model.fit["beta"]
    out = {r.g: r for r in model.fitted(df).groupBy("g").agg({"predicted_adherence": "sum", "y": "sum", "x1": "count"})
           .withColumnRenamed("sum(predicted_adherence)", "p").withColumnRenamed("sum(y)", "t")
           .withColumnRenamed("count(x1)", "n").collect()}
    for g, r in out.items():
        xs = [row for row in rows if row[0] == g]
        fe = sum(beta @ np.array([a[1], a[2], a[3]]) for a in xs)
        u = th * (r.t - fe) / (1 + r.n * th)
        assert r.p == pytest.approx(fe + r.n * u)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 3)) * [1.0, 5.0, 0.1]
    y = X @ [0.3, -0.1, 2.0] + rng.normal(size=80)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)], "a double, b double, c double, y double")
    b0, w = ridge_solve(gram_by(df, ["a", "b", "c"], "y", [])[()], alpha=1.0)
    mu, sd = X.mean(axis=0), X.std(axis=0)
    Z = (X - mu) / sd
    beta = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (y - y.mean()))
    assert np.allclose(w, beta / sd)
    assert b0 == pytest.approx(y.mean() - mu @ (beta / sd))


def test_small_stats():
    assert t_ppf(0.975, 4) == pytest.approx(2.776445, abs=1e-6)
    assert two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_ridge_gives_a_constant_column_no_weight(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(0.1, float(x), float(2 * x)) for x in rng.normal(size=101)],
                               "c double, x double, y double")
    b0, w = ridge_solve(gram_by(df, ["c", "x"], "y", [])[()], alpha=1.0)
    alone0, alone = ridge_solve(gram_by(df, ["x"], "y", [])[()], alpha=1.0)
    assert w[0] == 0.0 and w[1] == pytest.approx(alone[0]) and b0 == pytest.approx(alone0)
