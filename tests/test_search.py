import numpy as np

from notewise.operators.search import similarity_vectors, top_k


def _frames(spark, q, c):
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, v array<double>")
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cid long, v array<double>")
    return qdf, cdf


def test_top_k_matches_numpy(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 8)), rng.normal(size=(12, 8))
    qdf, cdf = _frames(spark, q, c)
    got = {(r.qid, r.rank): (r.corpus_id, r.score) for r in top_k(qdf, cdf, "qid", "v", "cid", "v", 5).collect()}
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    cn = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = qn @ cn.T
    for i in range(30):
        order = np.argsort(-s[i], kind="stable")[:5]
        for r, j in enumerate(order, start=1):
            assert got[(i, r)][0] == j
            assert abs(got[(i, r)][1] - s[i, j]) < 1e-12


def test_ties_zero_vector_and_small_corpus(spark):
    q = [[1.0, 0.0], [0.0, 0.0]]
    c = [[2.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    qdf, cdf = _frames(spark, q, c)
    rows = sorted((r.qid, r.rank, r.corpus_id, r.score) for r in top_k(qdf, cdf, "qid", "v", "cid", "v", 5).collect())
    # k = min(5, corpus size); equal scores -> smaller id; zero vector scores 0
    assert rows[:3] == [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0)]
    assert [r[3] for r in rows[3:]] == [0.0, 0.0, 0.0]


def test_large_corpus_is_joined_by_blocks_without_the_driver(spark, monkeypatch):
    from notewise.operators import search

    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 4)), rng.normal(size=(300, 4))
    c[100:160] = c[7]  # equal rows, more than a block holds
    q[3] = 0.0
    qdf, cdf = _frames(spark, q, c)
    one = sorted(tuple(r) for r in top_k(qdf, cdf, "qid", "v", "cid", "v", 5).collect())
    full = sorted((r.qid, r.sims) for r in similarity_vectors(qdf, cdf, "qid", "v", "cid", "v").collect())

    def fail(*_):
        raise AssertionError("the corpus was collected")

    monkeypatch.setattr(search, "_corpus_matrix", fail)
    many = sorted(tuple(r) for r in top_k(qdf, cdf, "qid", "v", "cid", "v", 5, max_bytes=100, block_rows=7).collect())
    assert many == one
    wide = sorted((r.qid, r.sims) for r in similarity_vectors(qdf, cdf, "qid", "v", "cid", "v", max_bytes=100,
                                                             block_rows=7).collect())
    assert wide == full and len(wide[0][1]) == 300


def test_hashed_tfidf_vectors(spark):
    import hashlib
    import math

    from notewise.operators.search import hash_idf, hash_vectors

    texts = [["a", "b", "a"], ["b", "c"], [], None, ["é", "c", "c", "a"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>").repartition(2)
    corpus = spark.createDataFrame([(0, ["c", "d"])], "id long, tokens array<string>")
    dims = 16
    idf = hash_idf([docs, corpus], "tokens", dims)
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims
    every = [t or [] for t in texts] + [["c", "d"]]
    for p in range(dims):
        n = sum(any(place(w) == p for w in t) for t in every)
        assert idf[p] == math.log(7 / (n + 1))
    got = {r.id: np.array(r.embedding) for r in hash_vectors(docs, "id", "tokens", idf).collect()}
    for i, t in enumerate(texts):
        x = np.zeros(dims)
        for w in t or []:
            x[place(w)] += idf[place(w)]
        n = np.linalg.norm(x)
        assert np.allclose(got[i], x / n if n else x, atol=1e-15)
    hits = top_k(hash_vectors(docs, "id", "tokens", idf), hash_vectors(corpus, "id", "tokens", idf), "id", "embedding",
                 "id", "embedding", 1)
    assert {r.id for r in hits.collect()} == {0, 1, 2, 3, 4}


def test_similarity_vectors_order_by_corpus_id(spark):
    qdf, cdf = _frames(spark, [[1.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]])
    r = similarity_vectors(qdf, cdf, "qid", "v", "cid", "v").collect()[0]
    assert r.sims == [0.0, 1.0]


def test_embed_with_caller_encoder_only_distinct_texts(spark):
    from notewise.operators.search import embed_with

    def encoder(texts):
        # letter counts a..c: a small deterministic stand-in for a sentence encoder
        return [[t.count("a"), t.count("b"), t.count("c")] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "aab"), (3, "abc"), (4, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed_with(df, "id", "text", encoder, 3).collect()}
    assert got[1] == got[3] == [1.0, 1.0, 1.0]
    assert got[2] == [2.0, 1.0, 0.0]
    assert got[4] == [0.0, 0.0, 0.0]
