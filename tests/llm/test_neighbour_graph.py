"""NN-descent and greedy search against brute force, with copies, odd vectors and clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewise.llm import neighbour_graph as ng
from notewise.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int, node string, q string, key long, rank string"


def direct(rows, query, k=10):
    """Of usable rows (id, vector): every query's k nearest (query_id, rank, vec_id, score)."""
    seen = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        seen.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for i, v in seen.items():
        if query(i):
            d = sorted((float(np.sqrt(((v - w)**2).sum())), j) for j, w in seen.items() if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d)]
    return sorted(out)


def run(df, every, **kw):
    return sorted(tuple(r) for r in ng.nearest_neighbours(df, F.col("vec_id") % every == 0, **kw).collect())


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 1_500)] + 0.3 * rng.standard_normal((1_500, 24))).astype(np.float32)
    x[600:700] = x[0]  # a group of copies, queries among them
    x[700] = -x[0]
    return [(i, [float(c) for c in v], 1, "n", "q", 3, "r") for i, v in enumerate(x)]


def odd(rows):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0] * 24, [1.0, None], [nan] * 24, [inf] + [0.0] * 23, [1.0, 2.0], [1.0, 2.5], [-0.0, 1.0],
               [0.0, 1.0], [9.0]]
    return [(5_000 + 10 * i, v, None, None, None, None, None) for i, v in enumerate(vectors)] \
        + [(None, rows[0][1], 1, "n", "q", 3, "r"), rows[10], rows[10]]


def test_small_table_is_exact(spark, rows):
    some = rows[:60] + rows[600:640] + odd(rows)  # fewer nodes than entry points
    df = spark.createDataFrame(some, SCHEMA).repartition(4)
    assert run(df, 10) == direct(some, lambda i: i % 10 == 0)
    assert run(df, 10, k=3) == direct(some, lambda i: i % 10 == 0, 3)
    few = some[:4]
    assert run(spark.createDataFrame(few, SCHEMA), 1) == direct(few, lambda i: True)  # all candidates, if fewer
    assert run(df.limit(0), 10) == []
    assert run(spark.createDataFrame(odd(rows)[:6], SCHEMA), 10) == []


def test_graph_search_recall(spark, rows):
    """64 entries of 1,400 nodes in blocks of 32: the graph has to lead from them to the neighbours."""
    df = spark.createDataFrame(rows + odd(rows), SCHEMA).repartition(4)
    want = direct(rows + odd(rows), lambda i: i % 5 == 0)
    got = run(df, 5, entries=64, beam=32, block=32, tables=4, degree=12, reverse=12)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    scores = {(r[0], r[2]): r[3] for r in direct(rows + odd(rows), lambda i: i % 5 == 0, 10_000)}
    assert all(scores[r[0], r[2]] == pytest.approx(r[3], rel=1e-12, abs=0) for r in got)
    hit = len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want})
    assert hit >= 0.97 * len(want)
    for a, b in zip(got, got[1:], strict=False):
        assert a[0] != b[0] or (a[3], a[2]) < (b[3], b[2])  # nearest first, ties to the smaller id


def test_search_of_vectors_that_are_no_nodes(spark, rows):
    """Queries without a node of their own start at the entry points alone."""
    nodes = spark.createDataFrame([(r[0], np.array(r[1], np.float32).tobytes()) for r in rows[:600]],
                                  "node long, vec binary").repartition(3)
    x = np.array([r[1] for r in rows[:600]], np.float64)
    graph, news = ng.build(nodes, np.float32, {24: x[:200]}, degree=12, reverse=12, block=32, tables=4)
    assert news == sorted(news, reverse=True) and all(len(r["nbrs"]) == 12 for r in graph.collect())
    rng = np.random.default_rng(1)
    asked = (x[:40] + 0.05 * rng.standard_normal((40, 24))).astype(np.float32)
    queries = spark.createDataFrame([(i, v.tobytes(), None) for i, v in enumerate(asked)], "q long, vec binary, start long")
    entries = {24: (np.arange(0, 600, 6), x[::6])}
    found = ng.search(nodes, graph, queries, np.float32, entries, beam=32, width=8).collect()
    hit = 0
    for i, v in enumerate(asked):
        best = [n for _, n in sorted((r["d"], r["node"]) for r in found if r["q"] == i)[:10]]
        hit += len(set(best) & set(np.argsort(((x - v.astype(float))**2).sum(1))[:10].tolist()))
    assert hit >= 0.95 * 400


@pytest.mark.parametrize("power", [200, -200])
def test_large_and_small_components(spark, rows, power):
    some = [(r[0], [c * 10.0**power for c in r[1]]) for r in rows[:80]]
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
    got = run(df, 10)
    x = np.array([r[1] for r in rows[:80]])
    for i in range(0, 80, 10):
        d = np.sqrt(((x - x[i])**2).sum(1))
        d[i] = np.inf
        mine = [r for r in got if r[0] == i]
        assert [r[2] for r in mine] == np.argsort(d, kind="stable")[:10].tolist()
        assert np.allclose([r[3] / 10.0**power for r in mine], np.sort(d)[:10], rtol=1e-9)
