"""The choice of k, through the registered queries, against a direct computation on small tables."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from notewise.plans import registry
from tests.test_coherence import _cv_direct

WORDS = ["river", "mountain", "forest", "village", "market", "harbor", "castle", "garden", "bridge", "meadow", "valley",
         "island", "desert", "canyon", "glacier", "lagoon"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = np.random.default_rng(7)
    d = tmp_path_factory.mktemp("sf")
    n = 50
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 40))) for _ in range(n)]
    texts[25] = " ".join(rng.choice(WORDS, 140))  # more than one window
    ids = pa.array(range(n), pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * n, "source": ["s"] * n,
                             "n_chars": pa.array([len(t) for t in texts], pa.int64())}), d / "documents.parquet")
    themes = [" ".join(rng.choice(WORDS, 4)) for _ in range(12)]
    pq.write_table(pa.table({"item_id": pa.array(range(12), pa.int64()), "text": themes}), d / "benchmark.parquet")
    return str(d), themes, texts


def _direct(themes, texts):
    every = [t.split() for t in texts + themes]
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1024 for w in WORDS}
    counts = np.zeros((len(every), 1024))
    for row, t in zip(counts, every, strict=True):
        for w in t:
            row[place[w]] += 1
    v = counts * np.log((len(every) + 1) / ((counts > 0).sum(0) + 1))
    v /= np.sqrt((v * v).sum(1))[:, None]
    x = np.round(v[:len(texts)] @ v[len(texts):].T, 12)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    tokens = [t.split() for t in texts]
    rows = {}
    for k in range(2, 16):
        c = x[:k].copy()
        for _ in range(300):
            lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
            moved = np.sqrt(((new - c) ** 2).sum(1)).max()
            c = new
            if moved <= 1e-12:
                break
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        own = sorted(set(lab))
        size = {j: (lab == j).sum() for j in own}
        sil = []
        for i in range(len(x)):
            b = min(dist[i, lab == j].mean() for j in own if j != lab[i])
            a = dist[i, lab == lab[i]].sum() / (size[lab[i]] - 1) if size[lab[i]] > 1 else None
            sil.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
        cen = np.array([x[lab == j].mean(0) for j in own])
        within = sum(((x[lab == j] - m) ** 2).sum() for j, m in zip(own, cen, strict=True))
        between = sum(size[j] * ((m - x.mean(0)) ** 2).sum() for j, m in zip(own, cen, strict=True))
        s = [np.sqrt(((x[lab == j] - m) ** 2).sum(1)).mean() for j, m in zip(own, cen, strict=True)]
        db = np.mean([max((s[i] + s[j]) / math.dist(cen[i], cen[j]) for j in range(len(own)) if j != i)
                      for i in range(len(own))])
        coh = _cv_direct(tokens, {j: [w for i in np.flatnonzero(lab == j) for w in tokens[i]] for j in own}, 110)
        rows[k] = {"silhouette_score": np.mean(sil), "davies_bouldin_index": db,
                   "calinski_harabasz_score": between / (len(own) - 1) / (within / (len(x) - len(own))),
                   "coherence_cv": np.mean([v for _, v in coh.values()])}
    norm = {}
    for c in rows[2]:
        v = np.array([rows[k][c] for k in rows])
        norm[c] = (v - v.min()) / (v.max() - v.min())
    norm["davies_bouldin_index"] = 1 - norm["davies_bouldin_index"]
    for i, k in enumerate(rows):
        rows[k]["composite_score"] = np.mean([norm[c][i] for c in norm])
    return rows


def test_scores_best_and_top_equal_direct_computation(spark, tables):
    registry.load_all()
    d, themes, texts = tables
    want = _direct(themes, texts)
    got = {r.k: r.asDict() for r in registry.QUERIES["k_scores"](spark, d).collect()}
    assert sorted(got) == sorted(want)
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == pytest.approx(v, abs=2e-4), (k, c)
    order = sorted(want, key=lambda k: (-want[k]["composite_score"], k))
    assert [r.optimal_k for r in registry.QUERIES["k_best"](spark, d).collect()] == order[:1]
    assert sorted(r.k for r in registry.QUERIES["k_top3"](spark, d).collect()) == sorted(order[:3])
    items = {r.item: r.k for r in registry.QUERIES["k_summary"](spark, d).collect()}
    assert items == {"current": 6, "optimal": order[0], **{f"top{i + 1}": k for i, k in enumerate(order[:3])}}
