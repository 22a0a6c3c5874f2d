import numpy as np
import pytest

from notewise.operators.clustering import (cluster_summary, lloyd, lloyd_many, measures_many,
                                           representatives, silhouette_samples, summary_metrics)


def _points(spark, x, lab=None):
    rows = [(i, [float(v) for v in x[i]]) + ((int(lab[i]),) if lab is not None else ()) for i in range(len(x))]
    schema = "id long, v array<double>" + (", cluster long" if lab is not None else "")
    return spark.createDataFrame(rows, schema)


def _np_silhouette(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_exact_with_singleton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    lab = np.array([0] * 15 + [1] * 15 + [2] * 9 + [3])
    got = {r.id: r.silhouette for r in silhouette_samples(_points(spark, x, lab), "id", "v").collect()}
    want = _np_silhouette(x, lab)
    assert max(abs(got[i] - want[i]) for i in range(40)) < 1e-10
    # points dealt to 40 blocks give the same answer
    got2 = {r.id: r.silhouette for r in silhouette_samples(_points(spark, x, lab), "id", "v", block_rows=1).collect()}
    assert max(abs(got2[i] - want[i]) for i in range(40)) < 1e-10


def test_db_ch_wcss_match_formulas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 4))
    lab = rng.integers(0, 4, 50)
    m = summary_metrics(cluster_summary(_points(spark, x, lab), "v"))
    cents = np.array([x[lab == c].mean(axis=0) for c in range(4)])
    w = sum(((x[lab == c] - cents[c]) ** 2).sum() for c in range(4))
    b = sum((lab == c).sum() * ((cents[c] - x.mean(axis=0)) ** 2).sum() for c in range(4))
    assert m["wcss"] == pytest.approx(w)
    assert m["calinski_harabasz_score"] == pytest.approx((b / 3) / (w / 46))
    s = np.array([np.sqrt(((x[lab == c] - cents[c]) ** 2).sum(axis=1)).mean() for c in range(4)])
    dist = np.sqrt(((cents[:, None] - cents[None]) ** 2).sum(axis=2))
    r = [max((s[i] + s[j]) / dist[i, j] for j in range(4) if j != i) for i in range(4)]
    assert m["davies_bouldin_index"] == pytest.approx(np.mean(r))
    assert m["cluster_size_std"] == pytest.approx(np.bincount(lab).std())


def _np_lloyd(x, c, rounds):
    c = c.copy()
    for _ in range(rounds):
        lab = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
        for j in range(len(c)):
            if (lab == j).any():
                c[j] = x[lab == j].mean(axis=0)
    return np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1), c


def test_lloyd_and_many_k_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    df = _points(spark, x)
    lab, cen = lloyd(df, "id", "v", x[:4], 6)
    want_lab, want_c = _np_lloyd(x, x[:4], 6)
    got = {r.id: r.cluster for r in lab.collect()}
    assert [got[i] for i in range(60)] == list(want_lab)
    many = lloyd_many(df, "v", {3: x[:3], 4: x[:4]}, 6)
    assert np.allclose(many[4], want_c)
    # the shared-pass measures equal the per-k ones
    ms = {m["k"]: m for m in measures_many(df, "id", "v", many)}
    labelled = _points(spark, x, want_lab)
    single = summary_metrics(cluster_summary(labelled, "v"))
    assert ms[4]["wcss"] == pytest.approx(single["wcss"])
    assert ms[4]["silhouette_score"] == pytest.approx(_np_silhouette(x, want_lab).mean())


def test_representatives_search_all_rows(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [10.0, 0.0], [0.9, 0.0]])
    reps = {r.cluster: r.id for r in representatives(_points(spark, x), "id", "v", np.array([[1.0, 0.0], [9.0, 0.0]])).collect()}
    assert reps == {0: 1, 1: 2}


def test_rank_within_hot_key(spark):
    from notewise.operators.clustering import rank_within

    rng = np.random.default_rng(9)
    keys = np.where(rng.random(500) < 0.8, 0, rng.integers(1, 4, 500))  # one key holds most rows
    vals = rng.normal(size=500)
    df = spark.createDataFrame([(i, int(k), float(v)) for i, (k, v) in enumerate(zip(keys, vals))], "id long, k long, v double")
    got = {r.id: r.pos for r in rank_within(df, "k", ["v", "id"]).collect()}
    for kv in set(keys):
        members = sorted((vals[i], i) for i in range(500) if keys[i] == kv)
        for pos, (_, i) in enumerate(members):
            assert got[i] == pos


def test_silhouette_squared_runs(spark):
    from notewise.operators.clustering import silhouette_squared

    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 8])
    lab = np.array([0] * 20 + [1] * 20)
    assert silhouette_squared(_points(spark, x, lab), "v") > 0.9


def test_components_of_a_long_path(spark):
    from notewise.operators.topics import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(301), 900, 901, 950]], "id long")
    got = {r["id"]: r["component"] for r in connected_components(edges, nodes).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900, 950: 950}


def test_kmeans_many_finds_the_best_of_converged_restarts(spark):
    from notewise.operators.clustering import kmeans_many

    rng = np.random.default_rng(6)
    centres = rng.normal(scale=6, size=(5, 3))
    x = np.vstack([c + rng.normal(size=(60, 3)) for c in centres])
    df = _points(spark, x).repartition(5)
    got = kmeans_many(df, "id", "v", [2, 5, 7], seed=1, restarts=8, tol=0.0)
    assert sorted(got) == [2, 5, 7]
    for k, (c, inertia) in got.items():
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        lab = d2.argmin(axis=1)
        assert inertia == pytest.approx(d2.min(axis=1).sum())
        assert np.allclose(c, [x[lab == j].mean(axis=0) for j in range(k)], atol=1e-9)  # a fixed point
    planted = sum(((x[60 * j:60 * j + 60] - x[60 * j:60 * j + 60].mean(axis=0)) ** 2).sum() for j in range(5))
    assert got[5][1] <= planted * (1 + 1e-9)
    # the same seeds give the same result from other partitions
    again = kmeans_many(_points(spark, x).repartition(2), "id", "v", [5], seed=1, restarts=8, tol=0.0)
    assert again[5][1] == pytest.approx(kmeans_many(df, "id", "v", [5], seed=1, restarts=8, tol=0.0)[5][1])


def test_kmeans_many_edge_cases(spark):
    from notewise.operators.clustering import kmeans_many

    same = _points(spark, np.ones((30, 2)))
    c, inertia = kmeans_many(same, "id", "v", [3], restarts=2)[3]
    assert inertia == 0 and (c == 1).all()  # fewer different rows than k: fewer centres
    assert kmeans_many(same.limit(0), "id", "v", [3], restarts=2) == {}


def test_nearest_breaks_ties_by_the_smaller_index():
    from notewise.operators.pairwise import nearest

    rng = np.random.default_rng(8)
    c = rng.normal(size=(9, 20))
    c[5] = c[2]
    c[8] = -c[0]
    x = np.vstack([rng.normal(size=(200, 20)), c, np.zeros((1, 20))])
    d2 = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    best, dist = nearest(x, c)
    assert (best == d2.argmin(axis=1)).all() and np.allclose(dist, d2.min(axis=1), rtol=1e-9, atol=1e-15)
