import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notewise.operators.cv import fold_segments, group_kfold, regression_metrics


def _greedy(sizes, ids, n_splits):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], -ids[i]))
    loads = [0] * n_splits
    out = {}
    for i in order:
        f = int(np.argmin(loads))
        loads[f] += sizes[i]
        out[ids[i]] = f + 1
    return out


def _from_segments(sizes, ids, n_splits):
    segs = fold_segments(sorted({(s, sizes.count(s)) for s in sizes}), n_splits)
    out = {}
    by_size = {}
    for s, g in sorted(zip(sizes, ids), key=lambda t: (-t[0], -t[1])):
        by_size.setdefault(s, []).append(g)
    for s, a, b, order in segs:
        for o in range(a, b):
            out[by_size[s][o]] = order[(o - a) % len(order)] + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=12), min_size=5, max_size=80), st.integers(2, 6))
def test_segments_equal_plain_greedy(sizes, n_splits):
    ids = list(range(len(sizes)))
    assert _from_segments(sizes, ids, n_splits) == _greedy(sizes, ids, n_splits)


def test_group_kfold_on_spark(spark):
    rng = np.random.default_rng(7)
    sizes = list(rng.integers(1, 9, 40)) + [200]  # one huge group
    rows = [(int(g), 1.0) for g, s in enumerate(sizes) for _ in range(int(s))]
    df = spark.createDataFrame(rows, "g long, y double")
    got = {r.g: r.fold for r in group_kfold(df, "g", 5).collect()}
    assert got == _greedy([int(s) for s in sizes], list(range(len(sizes))), 5)


def test_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "g long, y double")
    with pytest.raises(ValueError):
        group_kfold(df, "g", 5).collect()


def test_r2_constant_truth(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, 0.4), (2, 0.5, 0.6)], "fold long, y double, pred double")
    r = {x.fold: x.r2 for x in regression_metrics(df, "y", "pred").collect()}
    assert r == {1: 1.0, 2: 0.0}
