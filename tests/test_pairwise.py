import numpy as np
import pytest

from notewise.operators.clustering import measures_many, silhouette_samples
from notewise.operators.pairwise import block_count, pairs_within, squared_distances
from notewise.operators.topics import density_topics


def _points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_squared_distances_do_not_cancel():
    rng = np.random.default_rng(1)
    x = 1e3 + rng.normal(size=(60, 7))
    y = np.vstack([x[:20], x[20:40] + 1e-9, rng.normal(size=(10, 7))])
    want = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    got = squared_distances(x, y)
    assert np.allclose(got, want, rtol=1e-6, atol=0)
    assert (got[np.arange(20), np.arange(20)] == 0).all()


def test_block_count_bounds_bytes_and_occupies_the_cores():
    assert block_count(0, 100, 8) == 1
    assert block_count(100, 100, 8) == 1
    assert block_count(3_000, 100, 8) == 4
    assert block_count(10**7, 1_000, 8) >= 10**10 // (4 << 20)


@pytest.mark.parametrize("block_rows", [None, 5])
def test_pairs_within_equals_direct(spark, block_rows):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(230, 3)), 1)
    x[50:60] = x[0]  # copies
    x[60] = x[0] + [0.5, 0.0, 0.0]  # exactly on the radius
    got = {(r.id, r.nb): r.dist for r in pairs_within(_points(spark, x), "id", "v", 0.5, block_rows).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    want = {(int(i), int(j)): d[i, j] for i, j in zip(*np.nonzero(d <= 0.5))}
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 1e-12
    assert block_count(230, 1, 1, block_rows) in (1, 46)


def test_silhouettes_over_many_blocks_and_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(210, 4))
    x[:90] = x[0]  # a third and more are copies
    lab = rng.integers(0, 5, 210)
    df = spark.createDataFrame([(i, [float(c) for c in v], int(lab[i])) for i, v in enumerate(x)],
                               "id long, v array<double>, cluster long")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    want = []
    for i in range(210):
        m = {c: d[i, lab == c].sum() / ((lab == c).sum() - (c == lab[i])) for c in range(5)}
        a, b = m.pop(lab[i]), min(v for c, v in m.items() if c != lab[i])
        want.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in silhouette_samples(df, "id", "v", block_rows=5).collect()}
    assert len(got) == 210 and max(abs(got[i] - want[i]) for i in range(210)) < 1e-10
    null = spark.createDataFrame([(900, None, 1)], df.schema)
    assert silhouette_samples(df.union(null), "id", "v", block_rows=50).count() == 210
    assert silhouette_samples(df.limit(0), "id", "v").count() == 0
    # the sweep's shared pass, 42 blocks
    centres = {k: x[90:90 + k] for k in (2, 3)}
    many = {m["k"]: m["silhouette_score"] for m in measures_many(_points(spark, x), "id", "v", centres, block_rows=5)}
    for k, c in centres.items():
        own = np.argmin(((x[:, None, :] - c[None]) ** 2).sum(axis=2), axis=1)
        labelled = spark.createDataFrame([(i, [float(v) for v in x[i]], int(own[i])) for i in range(210)], df.schema)
        mean = np.mean([r.silhouette for r in silhouette_samples(labelled, "id", "v").collect()])
        assert many[k] == pytest.approx(mean, rel=1e-9)


def test_density_topics_equal_direct_grouping(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [5, 5], [9, 0]])
    x = np.vstack([c + 0.3 * rng.normal(size=(n, 2)) for c, n in zip(centres, (40, 30, 8))] + [rng.uniform(-9, 15, (20, 2))])
    eps, least = 0.6, 10
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    core = (d <= eps).sum(1) >= least
    comp = {i: i for i in np.flatnonzero(core)}
    while True:
        new = {i: min(comp[j] for j in comp if d[i, j] <= eps) for i in comp}
        if new == comp:
            break
        comp = new
    group = {}
    for i in range(len(x)):
        near = [(d[i, j], j) for j in comp if d[i, j] <= eps]
        group[i] = comp[min(near)[1]] if near else None
    sizes = {g: sum(v == g for v in group.values()) for g in set(group.values())}
    want = {i: -1 if g is None or sizes[g] < least else int(g) for i, g in group.items()}
    got = {r.id: r.raw_topic for r in density_topics(_points(spark, x), "id", "v", eps, least).collect()}
    assert got == want and len(set(want.values())) >= 3


def test_pairs_of_blocks_are_met_without_a_shuffle_of_their_own(spark):
    rng = np.random.default_rng(5)
    found = pairs_within(_points(spark, rng.normal(size=(90, 3))), "id", "v", 0.3, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "FlatMapGroupsInArrow" not in plan
    assert found.filter("id = nb").count() == 90  # every block met itself once


def test_density_links_grow_with_the_rows_not_their_pairs(spark, monkeypatch):
    from notewise.operators import topics

    seen, plain = [], topics.connected_components
    monkeypatch.setattr(topics, "connected_components", lambda e, *rest: seen.append(e.count()) or plain(e, *rest))
    x = np.vstack([np.zeros((300, 2)), np.full((200, 2), 3.0), [[0.5, 0.0], [1.5, 0.0]]])
    got = {r.id: r.raw_topic for r in topics.density_topics(_points(spark, x), "id", "v", 0.6, 100, block_rows=60).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{i: 300 for i in range(300, 500)}, 500: 0, 501: -1}
    assert seen[0] < 500 * 9 * 2  # before: a row per pair, 130,000
