"""Rounds of Lloyd over packed matrices: the same labels and sums as row by row, one job a round."""

import numpy as np

from notewise.operators.clustering import _packed, _sums_many, first_k_many, lloyd_many
from notewise.operators.pairwise import nearest, nearest_of_runs


def test_runs_share_a_product_and_keep_exact_ties():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(50, 4)), [[0.0] * 4, [1.0] * 4]])
    c = rng.normal(size=(5, 3, 4))
    c[1, 2] = c[1, 0]  # an exact tie goes to the smaller index
    c[2, 1], c[2, 0] = x[7], x[7] + 1e-9
    lab, d2 = nearest_of_runs(x, c)
    for run in range(5):
        want, dist = nearest(x, c[run])
        assert (lab[:, run] == want).all()
        np.testing.assert_allclose(d2[:, run], dist, atol=1e-12)


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>") \
        .repartition(5)


def test_sums_of_runs_of_different_k(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    inits = {"a": x[:3], "b": x[5:8], "c": x[:2]}
    packed = _packed(_frame(spark, x), "v")
    got = {(r["key"], r["cluster"]): r for r in _sums_many(packed, inits)}
    for key, c in inits.items():
        lab, d2 = nearest(x, c)
        for j in range(len(c)):
            r = got[key, j]
            assert r["n"] == (lab == j).sum()
            np.testing.assert_allclose(r["s"], x[lab == j].sum(0))
            np.testing.assert_allclose([r["w"], r["dsum"]], [d2[lab == j].sum(), np.sqrt(d2[lab == j]).sum()])
    assert _sums_many(_packed(_frame(spark, x).limit(0), "v"), inits) == []


def test_a_round_is_one_job(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    df = _frame(spark, x)
    sc = spark.sparkContext
    jobs = {}
    for rounds in (1, 4):
        sc.setJobGroup(f"lloyd-{rounds}", "rounds")
        lloyd_many(df, "v", first_k_many(df, "id", "v", [2, 3, 4]), rounds, tol=-1.0)
        jobs[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"lloyd-{rounds}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] - jobs[1] == 3


def test_project_2d_makes_its_vectors_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["project_2d"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    assert "MapInArrow" not in plan.split("InMemoryRelation")[0]
