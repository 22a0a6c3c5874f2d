import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.operators import cv
from notewise.operators.compare import compare_models
from notewise.operators.gam import bspline_basis, design, gam_cv, penalty, solve_gcv
from notewise.operators.models import (baselines, fit_lme, forest_cv, independent_columns, ridge_cv, score_external,
                                       training_medians)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        g = int(rng.integers(0, 25)) if i % 3 else 0  # one participant holds a third of the rows
        x1, x2 = rng.random(2)
        out.append((i, f"p{g}", "A" if i % 2 else "B", float(x1), float(x2), float(i % 3),
                    float(np.clip(0.3 + 0.4 * x1 * x1 + 0.02 * g + 0.05 * rng.normal(), 0, 1).round(2))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    base = spark.createDataFrame(rows, "id long, participant string, drug string, x1 double, x2 double, c double, y double")
    return cv.with_folds(base.repartition(5), "participant", 5, by="drug").persist()


def test_folds_are_made_per_value(df, rows):
    got = df.select("drug", "participant", "fold").distinct().collect()
    assert len({(r.drug, r.participant) for r in got}) == len(got)
    for d in "AB":
        assert {r.participant for r in got if r.drug == d} == {r[1] for r in rows if r[2] == d}
        assert {r.fold for r in got if r.drug == d} == {1, 2, 3, 4, 5}


def test_training_medians_from_counts(spark, df):
    p = df.select("drug", "fold", "y").toPandas()
    got = {(r.drug, r.fold): r.median_pred for r in training_medians(df, "y", ["drug"]).collect()}
    assert got == {(d, f): pytest.approx(np.median(p.y[(p.drug == d) & (p.fold != f)])) for d in "AB" for f in range(1, 6)}
    odd = spark.createDataFrame([(1, 5.0), (1, None), (2, 1.0), (2, 1.0), (3, 2.0)], "fold long, y double")
    assert {r.fold: r.median_pred for r in training_medians(odd, "y", []).collect()} == {1: 1.0, 2: 3.5, 3: 1.0}


def test_metrics_in_one_pass(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(1e6, 1, 300), rng.normal(1e6, 1, 300)
    m = cv.regression_metrics(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, p, strict=True)],
                                                    "fold long, y double, pred double")).first()
    assert m.mae == pytest.approx(np.abs(y - p).mean()) and m.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)
    same = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 2.0), (2, 1.0, 3.0)], "fold long, y double, pred double")
    assert {r.fold: r.r2 for r in cv.regression_metrics(same).collect()} == {1: 1.0, 2: 0.0}


def test_singular_designs_drop_the_later_columns(spark, df):
    assert independent_columns(np.zeros((2, 2))) == []
    x = np.random.default_rng(2).normal(size=(50, 3))
    x = np.column_stack([np.ones(50), x, x[:, 0] - 2 * x[:, 1] + 3, np.zeros(50), x[:, 2] * 1e-6 + 1])
    assert independent_columns(x.T @ x) == [0, 1, 2, 3]
    one = df.filter("drug = 'A'").withColumn("Intercept", F.lit(1.0)).withColumn("none", F.lit(0.0)) \
        .withColumn("both", F.col("x1") + F.col("x2"))
    full = fit_lme(one, "y", ["Intercept", "x1", "x2"], "participant")
    more = fit_lme(one, "y", ["Intercept", "x1", "none", "x2", "both"], "participant")
    assert [r.Parameter for r in more.dropped(spark).collect()] == ["none", "both"]
    assert np.allclose(more.fit["beta"][[0, 1, 3]], full.fit["beta"], rtol=1e-6)
    assert {r.Parameter for r in more.coefficients(spark).collect()} == {"Intercept", "x1", "x2", "Group Var",
                                                                         "Group Var / Scale"}


def test_in_sample_metrics_of_the_fitted_values(df):
    one = df.filter("drug = 'A'").withColumn("Intercept", F.lit(1.0))
    model = fit_lme(one, "y", ["Intercept", "x1", "x2"], "participant")
    p = model.fitted(one).toPandas()
    m = model.in_sample(one).first()
    e = p.y - p.predicted_adherence
    assert m.mae == pytest.approx(e.abs().mean()) and m.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert m.r2 == pytest.approx(1 - (e**2).sum() / ((p.y - p.y.mean()) ** 2).sum())


def test_spline_basis_goes_on_along_its_tangents():
    x = np.linspace(0, 2, 41)
    b = bspline_basis(x, 0, 2, 5)
    assert np.allclose(b.sum(1), 1)
    coef = np.array([0.3, -1.0, 2.0, 0.5, 1.5])
    f = lambda t: bspline_basis(np.atleast_1d(np.asarray(t, float)), 0, 2, 5) @ coef
    h = 1e-6
    for edge, away in ((0.0, -1.0), (2.0, 1.0)):
        slope = (f(edge) - f(edge - away * h)) / (away * h)
        for t in (0.1, 1.0, 25.0):
            assert f(edge + away * t) == pytest.approx(f(edge) + slope * away * t, abs=1e-4 * max(1, t))


def test_gam_folds_equal_a_numpy_fit(df):
    got = {(r.drug, r.fold): r.rmse for r in gam_cv(df, "y", ["x1"], "x2", ["c"], by="drug").collect()}
    p = df.toPandas()
    for (d, f), rmse in got.items():
        train, test = p[(p.drug == d) & (p.fold != f)], p[(p.drug == d) & (p.fold == f)]
        x = lambda t: t[["x1", "x2", "c"]].to_numpy()
        ranges = [(train[c].min(), train[c].max()) for c in ("x1", "x2")]
        b = design(x(train), ranges, [5, 4], 1)
        y = train.y.to_numpy()
        _, beta = solve_gcv(b.T @ b, b.T @ y, y @ y, len(y), penalty([5, 4], 1))
        pred = np.clip(design(x(test), ranges, [5, 4], 1) @ beta, 0, 1)
        assert rmse == pytest.approx(np.sqrt(((test.y - pred) ** 2).mean()), rel=1e-6)


def test_forest_and_external_scoring(spark, df):
    step = df.withColumn("y", F.when(F.col("x1") > 0.5, 0.9).otherwise(0.1))  # one split tells everything
    m = forest_cv(step, "y", ["x1", "c"], by="drug", trees=5, depth=3).collect()
    assert len(m) == 10 and all(r.mae < 0.12 and r.model == "Random_Forest" for r in m)
    p = df.toPandas()
    got = {r.fold: r.mae for r in score_external(df, lambda x: 3 * x[:, 0] - x[:, 1], ["x1", "x2"], "y").collect()}
    for f, mae in got.items():
        t = p[p.fold == f]
        assert mae == pytest.approx((t.y - np.clip(3 * t.x1 - t.x2, 0, 1)).abs().mean())


def test_comparison_is_ordered_and_skips_failures(df, caplog):
    def broken():
        raise ValueError("cannot be fitted")

    with caplog.at_level(logging.WARNING):
        got = compare_models({"baselines": ("Baseline", lambda: baselines(df, "y", "drug")), "gone": ("Other", broken),
                              "ridge": ("Linear", lambda: ridge_cv(df, "y", ["x1", "x2"], by="drug"))}).collect()
    assert "gone left out" in caplog.text
    for d in "AB":
        some = [r for r in got if r.drug == d]
        assert [r.position for r in some] == [1, 2, 3]
        assert [r.MAE_mean for r in some] == sorted(r.MAE_mean for r in some)
        assert some[0].model == "Ridge_Regression" and some[0].Model_Type == "Linear"
        assert {r.model for r in some} == {"Ridge_Regression", "Mean_Baseline", "Median_Baseline"}
    with pytest.raises(RuntimeError):
        compare_models({"gone": ("Other", broken)})
