"""The training-data operators against brute force, on small frames with nulls, empty texts, ties and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from notewise.llm import (embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, quality, sharding,
                          substring_dedup, warc)
from notewise.llm.common import components, rank_in_key
from notewise.llm.tokens import buffers, words
from notewise.session import ship_package

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "bucket string, row long, name string, sig long"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark):
    ship_package(spark)
    rnd = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(60, 200))) for _ in range(25)]
    for t in texts[:12]:  # near copies
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "CHANGED"
        texts.append("\n".join(w))
    passage = " ".join(rnd.choices(vocab, k=70))
    for i in range(15, 22):
        texts[i] = texts[i] + " " + passage + " tail" * i
    texts += [texts[0]] * 5 + ["", None, None, "one", "ONE", "a b c", "a b c", " \t\n", "x" * 700_000 + " y", "!!! 123"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, 1, "b", 7, "n", 9)
            for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "no id here", None, None, 1, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, f"doc_id long, text string, lang string, source string, n_chars long, "
                                         f"{EXTRA.replace('row long', 'shard long')}").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["A bC\tdé", None, "", "  x ", "y" * 600_000 + " z", "ab  c\x0bd\x0ce\x1ff", "last"]
    _, row = words(*buffers(pa.array(texts)))
    assert Counter(row.tolist()) == {i: len(split(t)) for i, t in enumerate(texts) if split(t)}


def test_rank_and_components(spark):
    df = spark.createDataFrame([(k, i % 7) for i in range(50) for k in ("a", None)], "k string, v long")
    got = rank_in_key(df, "k", ["v"]).collect()
    for k in ("a", None):
        rows = sorted((r["rank_"], r["v"]) for r in got if r["k"] == k)
        assert [r for r, _ in rows] == list(range(50)) and [v for _, v in rows] == sorted(v for _, v in rows)
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(docs, corpus, nothing):
    got = exact_dedup.exact_dedup(docs, block_bytes=64).collect()
    assert len(got) == len(corpus)
    groups: dict = {}
    for r in corpus:
        groups.setdefault(r[1] or "", []).append(r[0])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_ngram_join(docs, corpus, nothing):
    sets = []
    for r in corpus:
        w = split(r[1])
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(parent, b)] = find(parent, a)
    low: dict = {}
    for i, r in enumerate(corpus):
        if r[0] is not None:
            low[find(parent, i)] = min(low.get(find(parent, i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), low.get(find(parent, i))) for i, r in enumerate(corpus))
    for options in ({}, {"list_size": 2, "bucket_size": 300}):
        got = Counter(map(tuple, ngram_join.ngram_join(docs, **options).collect()))
        assert got == want
    assert ngram_join.ngram_join(nothing).count() == 0


def test_prefix_filters_never_lose_a_link():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 80))
        a = set(rnd.integers(0, 10**6, n).tolist())
        b = set(list(a)[:int(rnd.integers(1, len(a) + 1))]) | set(rnd.integers(0, 10**6, n // 6).tolist())
        if not ngram_join.linked(len(a & b), len(a), len(b)):
            continue
        key = [np.array(sorted(s), np.uint64) << np.uint64(32) for s in (a, b)]
        low = [ngram_join._lowest(k) for k in key]
        assert ngram_join._overlap(*low, np.uint32) >= min(ngram_join.margin(len(a)), ngram_join.margin(len(b)))


def test_parity_bitmaps_and_forest():
    rnd = np.random.default_rng(7)
    for n in (3, 200, 511, 513, 3_000, 40_000):
        a = np.unique(rnd.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 8:], rnd.integers(0, 2**62, n // 9).astype(np.uint64)]))
        p, q = ngram_join._parities(a), ngram_join._parities(b)
        size = min(len(p), len(q))
        x, y = ngram_join._folded(p, size), ngram_join._folded(q, size)
        assert int(ngram_join._differ(x[None], y[None])[0]) <= len(np.setxor1d(a, b))
    for _ in range(50):
        group = rnd.integers(0, 12, 30)
        x, y = rnd.integers(0, 30, 60), rnd.integers(0, 30, 60)
        x, y = x[group[x] != group[y]], y[group[x] != group[y]]
        span = ngram_join._forest(x, y, rnd.random(len(x)), group)
        roots = []
        for edges in (range(len(x)), span):
            parent = {int(g): int(g) for g in group}
            for i in edges:
                parent[find(parent, int(group[x[i]]))] = find(parent, int(group[y[i]]))
            roots.append(sum(g == r for g, r in parent.items()))
        assert roots[0] == roots[1] and len(span) == len(set(group.tolist())) - roots[0]


def test_language_id(docs, corpus, nothing):
    rows = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(rows[r[0]]["lang_pred"] == "und" for r in corpus if not any(c.isalpha() for c in r[1] or ""))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows.values())
    assert language_id.language_id(nothing).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert language_id.keep_identified(docs).count() > 980


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["quality_prob"] <= 1 for r in got)
    assert quality.quality(nothing, labels).count() == 0
    assert {r["doc_prob"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = quality.quality(real, truth).join(truth, "doc_id").filter("held_out").toPandas()
    assert (held.kept == (held.quality == 1)).mean() > 0.95
    # groups of few rows are drawn to the mean, and equal groups give a strong prior
    assert quality.prior_strength(10, 1000.0, 100_000.0, 9.0) > 1e5
    assert quality.prior_strength(10, 1000.0, 100_000.0, 500.0) < 5


def test_packing(docs, corpus, nothing):
    rnd = random.Random(1)
    for _ in range(200):
        lengths = sorted(rnd.sample(range(60), rnd.randint(1, 8)))
        h, k = [(n, rnd.randint(1, 9)) for n in lengths], rnd.randint(1, 5)

        def padding(bounds, h=h):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in h)

        best = min(padding((*c, lengths[-1])) for m in range(min(k, len(lengths)))
                   for c in itertools.combinations(lengths[:-1], m))
        got, bounds = packing.optimal_bounds(h, k)
        assert got == best == padding(bounds) and len(bounds) <= k
    got = packing.pack(docs, buckets=3, token_budget=400).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len(split(r[1]))) for r in corpus)
    batches: dict = {}
    for r in got:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 400
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert packing.pack(nothing).count() == 0


def test_mixing(docs, nothing):
    for weights in ({"a": .9, "b": .05, "c": .05}, {"a": 1, "b": 1, "c": 1}, {str(i): 1 / (i + 1) for i in range(19)}):
        shares = mixing.quantise(weights, 512)
        got = dict.fromkeys(shares, 0)
        for t, s in enumerate(mixing.period(shares), 1):
            got[s] += 1
            assert all(abs(got[x] - shares[x] * t / 512) < 1 for x in shares)
        assert got == shares
    rows = mixing.mix_sources(docs, block_rows=4).collect()
    assert len(rows) == docs.count()
    slots = {(r["source"], r["block"]): r["slot"] for r in rows}
    assert sorted(slots.values()) == list(range(len(slots)))
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, weights={"s0": 1.0})


def test_sharding(docs, corpus, nothing):
    rnd = random.Random(2)
    for _ in range(200):
        sizes, parts = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))], rnd.randint(1, 5)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes))))
                   for m in range(min(parts, len(sizes))) for c in itertools.combinations(range(1, len(sizes)), m))
        capacity, cuts = sharding.minimax_cuts(sizes, parts)
        assert capacity == best == max(sum(sizes[a:b]) for a, b in itertools.pairwise([*cuts, len(sizes)]))
    got = sharding.shard_documents(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1) for r in corpus)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    home: dict = {}
    for r in got:
        home.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in home.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_warc(spark):
    ship_package(spark)
    html = ["<p>é\r\n\r\nWARC/1.0\r\n</p>", "same", "same", None, "", "same", "x" * 3_000_000, "\n\n", None]
    pages = [(i, f"http://h/{i} q" if i % 4 else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string").repartition(3)
    got = {r["page_id"]: r for r in warc.archive_pages(df).collect()}
    assert len(got) == len(pages)
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        last = max((p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None), default=None)
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == last else ("revisit", last))
    assert warc.archive_pages(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive_pages(df, min_revisit_bytes=10).collect()} == {"response"}
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
        block = warc.arc_version_block(version, "x.arc")
        arc = block + b"\n" + warc.arc_line(version, "http://a b/", "1999", "text/html", len(body)) + body + b"\n"
        first, second = warc.parse_arc(arc)
        assert (first["number"], second["URL"], second["body"]) == (-1, "http://a%20b/", body)
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 0.0.0.0 1999 text/html 99\nshort"))


def test_embeddings(spark):
    ship_package(spark)
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rnd.standard_normal(16) * 0.05 * (i // 24)).tolist(), i % 3) for i in range(96)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, None, 0), (n + 3, [0.0] * 16, 0),
             (n + 4, [float("nan")] * 16, 0), (n + 5, [None] * 16, 0), (n + 6, [], 0), (n + 7, rows[0][1][:8], 0),
             (n + 8, [float("inf")] + [0.0] * 15, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    parent, links = {r[0]: r[0] for r in rows}, Counter()

    def usable(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None for x in r[1]) \
            and np.isfinite(r[1]).all() and any(r[1])

    for x, y in itertools.combinations([r for r in rows if usable(r)], 2):
        if x[2] == y[2] and len(x[1]) == len(y[1]) and \
                np.dot(x[1], y[1]) / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.98:
            links[x[0]] += 1
            links[y[0]] += 1
            a, b = sorted((find(parent, x[0]), find(parent, y[0])))
            parent[b] = a
    for block in (2_048, 3):
        got = embedding_dedup.near_embeddings(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], find(parent, r["vec_id"]))
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_compact_windows_are_cartesian_tree_nodes():
    rnd = np.random.default_rng(6)
    for _ in range(100):
        t, h = int(rnd.integers(2, 9)), rnd.integers(0, 2**60, int(rnd.integers(0, 50))).astype(np.uint64)
        starts, want = np.array([0, len(h)]), set()
        got = substring_dedup.compact_windows(h, np.zeros(len(h), int), starts, t, 2)
        for j in range(2):
            v = ((substring_dedup.mix(h ^ substring_dedup._SEEDS[j]) & ~np.uint64(7)) | np.uint64(j)).tolist()
            left, right, stack = [0] * len(v), [len(v) - 1] * len(v), []
            for i, x in enumerate(v):
                while stack and v[stack[-1]] > x:
                    right[stack.pop()] = i - 1
                left[i] = stack[-1] + 1 if stack else 0
                stack.append(i)
            want |= {(x, max(left[i], i - t + 1), min(right[i], i + t - 1)) for i, x in enumerate(v)
                     if right[i] - left[i] + 1 >= t}
        assert set(zip(got[0].tolist(), got[2].tolist(), got[3].tolist(), strict=True)) == want


def test_repeated_passages(docs, corpus, nothing):
    runs: dict = {}
    for i, r in enumerate(corpus):
        w = split(r[1])
        for at in range(len(w) - 49):
            runs.setdefault(tuple(w[at:at + 50]), set()).add(i)
    want = {corpus[i][0] for ids in runs.values() if len(ids) > 1 for i in ids}
    for options in ({}, {"flush_at": 50, "bucket_size": 100}):
        got = substring_dedup.repeated_passages(docs, **options).collect()
        assert want <= {r["doc_id"] for r in got}
        words_of = {r[0]: len(split(r[1])) for r in corpus}
        assert all(0 <= r["start_word"] <= r["end_word"] - 50 <= words_of[r["doc_id"]] - 50 for r in got)
        assert all(r["first_doc"] <= r["doc_id"] for r in got)
    assert substring_dedup.repeated_passages(nothing).count() == 0
    assert substring_dedup.passages(np.arange(60, dtype=np.uint64), np.arange(30, 200, dtype=np.uint64), 30) \
        == [(30, 60, 0, 30)]


def test_repeated_passages_find_what_no_pivot_holds(spark):
    """Pairs of variants at 0.75 to 1 that share one frequent line with many texts, against all pairs."""
    ship_package(spark)
    rnd, t = random.Random(5), substring_dedup.MIN_WORDS - substring_dedup.WORDS + 1

    def text(n):
        return [f"v{rnd.randrange(10**6)}" for _ in range(n)]

    line, texts = text(30), []
    for _ in range(40):
        texts.append(text(40) + line + text(40))
    for _ in range(15):  # two variants of a passage around the line, each in a text of its own
        left, right = text(25), text(25)
        for _ in range(2):
            body = left + line + right
            body[rnd.randrange(len(body))] = text(1)[0]
            texts.append(text(30) + body + text(30))
    rnd.shuffle(texts)
    data = [" ".join(x) for x in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x.encode()) for x in data])))
    seq = substring_dedup.Sequences(np.frombuffer("".join(data).encode(), np.uint8), offsets)
    value, row, l, r = substring_dedup.compact_windows(seq.h, seq.row, seq.starts, t)
    near = {i: [] for i in range(len(data))}
    for a, b in itertools.combinations(range(len(data)), 2):
        x, y = np.flatnonzero(row == a), np.flatnonzero(row == b)
        p, q = np.nonzero(value[x][:, None] == value[y])
        p, q = x[p], y[q]
        sa, sb = (seq.h[seq.starts[i]:seq.starts[i + 1]] for i in (a, b))
        for la, ra, lb, rb in substring_dedup.regions(value[p] & np.uint64(7), l[p], r[p], l[q], r[q], t):
            if substring_dedup.passages(sa[la:ra + 1], sb[lb:rb + 1], t):
                near[a].append(b)
                near[b].append(a)
    want = {i for i, x in near.items() if x}
    assert len(want) >= 20
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    for options in ({}, {"flush_at": 300, "bucket_size": 500, "block": 4, "cells": 50}):
        got = substring_dedup.repeated_passages(docs, **options).collect()
        first = {r["doc_id"]: r["first_doc"] for r in got}
        assert set(first) == want
        assert all(first[i] == first[j] for i in want for j in near[i])


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, d)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == ids
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({texts[i] for i in ids}) == len(ids) > 0.85 * len(set(texts.values()))


def test_packing_follows_the_mix(spark, monkeypatch):
    import corpus_pipeline

    rows = [(i, "word " * 50, "a" if i < 400 else "b") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for weights in ({"a": .5, "b": .5}, {"a": .2, "b": .8}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        at = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix_sources(docs, weights).collect()}
        packed = corpus_pipeline.packing(spark, docs, "").collect()
        assert len({r["bucket"] for r in packed}) == 1
        packed.sort(key=lambda r: (r["batch"], r["slot"]))
        assert [r["doc_id"] for r in packed] == sorted(at, key=at.get)
        got.append({r["doc_id"]: (r["batch"], r["slot"]) for r in packed})
    assert got[0] != got[1]


def test_mix_keeps_the_given_weights(spark):
    rnd = random.Random(11)
    cases = [({"a": .9, "b": .1}, 40_000), ({"a": .9, "b": .0999, "c": .0001}, 30_000),
             ({str(i): (i + 1) ** 2 for i in range(1_500)}, 4_000), ({str(i): rnd.random() ** 3 for i in range(12)}, 5_000)]
    for weights, slots in cases:
        total = sum(weights.values())
        part = {s: w / total for s, w in weights.items()}
        phase = mixing.phases({s: slots for s in weights}, weights)[0]
        order = [None] * phase["size"]
        for s, at in phase["at"].items():
            for x in at:
                order[x] = s
        assert None not in order
        given = dict.fromkeys(weights, 0)
        many = len(weights) > 100
        for t in range(1, min(slots, phase["length"]) + 1):
            given[order[(t - 1) % phase["size"]]] += 1
            if not many or t % 97 == 0:
                assert all(abs(given[s] - part[s] * t) < 1 + 1e-6 for s in weights)
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(6_000)], "doc_id long, source string")
    rows = mixing.mix_sources(docs, {"a": .9003, "b": .0997}, block_rows=1).collect()
    order = [r["source"] for r in sorted(rows, key=lambda r: r["slot"])]
    assert sorted(r["slot"] for r in rows) == list(range(6_000))
    ends = max(r["slot"] for r in rows if r["phase"] == 0) + 1
    assert all(abs(order[:t].count("a") - .9003 * t) < 1 + 1e-6 for t in range(1, ends, 37))
