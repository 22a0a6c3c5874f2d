"""Paths that hold at any size: ranks and lemmas in the JVM, many levels, many topics, stored models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.functions.text import lemma_table, lemmatize_tokens, preprocess_notes
from notewise.operators.clustering import rank_within
from notewise.operators.encode import label_encode, level_codes
from notewise.operators.models import fit_lme, gram_by, ridge_solve
from notewise.operators.store import (kmeans_labels, linear_predictions, load_lme, load_params, save_kmeans, save_linear,
                                      save_lme, save_params)
from notewise.operators.topics import topic_membership


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lemmas_stay_in_the_jvm_and_keep_every_row(spark):
    rows = [(1, "pills pill glasses the glass pills"), (2, None), (2, "pills"), (2, "glasses glass"), (None, "boxes box"), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    out = preprocess_notes(df, "id", "text")
    assert not [w for w in ("MapInPandas", "MapInArrow", "PythonUDF", "ArrowEvalPython") if w in _plan(out)]
    got = sorted(((r.id or 0), tuple(r.tokens)) for r in out.collect())
    assert got == [(0, ("box", "box")), (1, ("pill", "pill", "glass", "glass", "pill")), (2, ()), (2, ("glass", "glass")),
                   (2, ("pill",)), (3, ())]
    table = spark.createDataFrame([("worse", "bad")], "token string, lemma string")
    docs = spark.createDataFrame([(1, ["worse", "x", "worse"]), (1, ["worse"])], "id long, tokens array<string>")
    assert sorted(tuple(r.lemmas) for r in lemmatize_tokens(docs, "id", "tokens", table).collect()) \
        == [("bad",), ("bad", "x", "bad")]
    flat = docs.select(F.explode("tokens").alias("token"))
    assert {r.token: r.lemma for r in lemma_table(flat, "token", table).collect()} == {"worse": "bad"}


def test_ranks_of_null_and_hot_keys_without_python(spark):
    rng = np.random.default_rng(3)
    keys = [None if k == 3 else int(k) for k in rng.choice([0, 0, 0, 1, 2, 3], 600)]
    df = spark.createDataFrame([(i, k, float(rng.integers(0, 9))) for i, k in enumerate(keys)], "id long, k long, v double")
    out = rank_within(df, "k", [F.desc("v"), "id"])
    assert "MapIn" not in _plan(out)
    got = {r.id: r.pos for r in out.collect()}
    rows = {r.id: r for r in df.collect()}
    for k in {None, 0, 1, 2}:
        order = sorted((r for r in rows.values() if r.k == k), key=lambda r: (-r.v, r.id))
        assert [got[r.id] for r in order] == list(range(len(order)))


def test_codes_of_fifty_thousand_levels(spark):
    df = spark.range(0, 60_000).select("id", F.format_string("v%06d", (F.col("id") * 7919) % 50_000).alias("v")) \
        .unionByName(spark.createDataFrame([(-1, None)], "id long, v string"))
    got = label_encode(df, "v", "code")
    assert got.filter("code = CAST(substring(v, 2) AS BIGINT)").count() == 60_000
    assert [r.code for r in got.filter("id = -1").collect()] == [None]
    assert level_codes(df, "v").count() == 50_000


@pytest.mark.parametrize("max_bytes", [1 << 28, 1_000])
def test_membership_in_five_thousand_topics(spark, max_bytes):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5_020, 4))
    topic = [i if i < 5_000 else -1 for i in range(5_020)]
    df = spark.createDataFrame([(i, [float(c) for c in v], t) for i, (v, t) in enumerate(zip(x, topic, strict=True))],
                               "id long, v array<double>, topic long")
    few = df.filter("id >= 4990").select("id", "v", "topic")
    both = few.withColumn("q", F.lit(True)).unionByName(df.filter("id < 4990").withColumn("q", F.lit(False)))
    out = topic_membership(both, "id", "v", "topic", max_bytes=max_bytes, block_rows=1_300).filter("id >= 5000")
    plan = _plan(out)
    assert len(plan) < 200_000  # no centroid is a literal
    u = x / np.sqrt((x * x).sum(1))[:, None]
    e = np.exp(u[5_000:] @ u[:5_000].T)
    want = e / e.sum(1, keepdims=True)
    got = out.toPandas()
    assert len(got) == 20 * 5_000
    assert np.abs(got.prob.to_numpy() - want[got.id - 5_000, got.topic]).max() < 1e-12


def test_stored_models_predict_as_before(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = x @ [0.3, -0.2] + 0.5 + 0.01 * rng.normal(size=80)
    df = spark.createDataFrame([(i, f"g{i % 7}", float(a), float(b), float(t), [float(a), float(b)])
                                for i, ((a, b), t) in enumerate(zip(x, y, strict=True))],
                               "id long, g string, a double, b double, y double, v array<double>")
    save_kmeans(spark, f"{tmp_path}/km", x[:3], "v")
    labels = {r.id: r.cluster for r in kmeans_labels(df, f"{tmp_path}/km", "id").collect()}
    assert [labels[i] for i in range(80)] == ((x[:, None] - x[None, :3]) ** 2).sum(2).argmin(1).tolist()
    b, w = ridge_solve(gram_by(df, ["a", "b"], "y", [])[()])
    save_linear(spark, f"{tmp_path}/ridge", b, w, ["a", "b"])
    got = {r.id: r.predicted for r in linear_predictions(df, f"{tmp_path}/ridge", clip=False).collect()}
    assert np.allclose([got[i] for i in range(80)], b + x @ w, rtol=1e-12)
    one = df.withColumn("Intercept", F.lit(1.0))
    model = fit_lme(one, "y", ["Intercept", "a", "b"], "g")
    save_lme(spark, f"{tmp_path}/lme", model)
    again = load_lme(spark, f"{tmp_path}/lme")
    a = {r.id: r.predicted_adherence for r in model.fitted(one).collect()}
    assert {r.id: r.predicted_adherence for r in again.fitted(one).collect()} == pytest.approx(a)
    with pytest.raises(ValueError):
        load_params(spark, f"{tmp_path}/lme", "kmeans")
    save_params(spark, f"{tmp_path}/gam", "gam", {"knots": np.arange(6.0).reshape(2, 3), "none": np.zeros((0, 4))}, {"k": 5})
    arrays, settings = load_params(spark, f"{tmp_path}/gam", "gam")
    assert arrays["knots"].tolist() == [[0, 1, 2], [3, 4, 5]] and arrays["none"].shape == (0, 4) and settings == {"k": 5}
