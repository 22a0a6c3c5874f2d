"""Nearest centres of many runs: exact where the Gram form is not, in about one matrix of distances."""

import tracemalloc

import numpy as np

from notewise.operators.pairwise import nearest_of_runs


def test_nearest_of_runs_holds_about_one_matrix():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(2000, 20)), rng.normal(size=(20, 15, 20))
    tracemalloc.start()
    nearest_of_runs(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * len(x) * 20 * 15


def test_nearest_of_runs_against_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) + 1000.0  # far from the origin: small distances are lost in the Gram form
    c = np.stack([x[:4], x[[7, 7, 9, 9]] + [[0], [0], [1e-5], [-1e-5]], x[10:14] + 1e-6])
    lab, d2 = nearest_of_runs(x, c)
    exact = ((x[:, None, None, :] - c) ** 2).sum(3)
    assert (lab == exact.argmin(2)).all()
    # where the least distance is small it comes from the differences
    small = exact.min(2) < 1e-3
    np.testing.assert_allclose(d2[small], exact.min(2)[small], rtol=1e-9)
