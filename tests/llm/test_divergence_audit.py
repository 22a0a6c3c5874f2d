"""The divergence audit against a direct computation, with long terms, nulls, ties, repeats and small bounds."""

import random
import re
from collections import Counter, defaultdict

import pytest

from notewise.llm.divergence_audit import _blocks, _BLOCK_DDL, kept_terms, source_divergence
from notewise.session import ship_package

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, count string, bucket string, prefix long"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def direct(rows, min_docs=10, top=10):
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = terms(text)
        seen[lang or ""].update(set(words))
        groups[lang or "", source or ""].update(words)
    out = []
    for (lang, source), counts in groups.items():
        kept = sorted(w for w, n in seen[lang].items() if n >= min_docs)
        v = len(kept)

        def share(c, kept=kept, v=v):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * v) for w in kept}

        mine = share(counts)
        whole = Counter()
        for (other, _), c in groups.items():
            if other == lang:
                whole.update(c)
        q = share(whole)
        part = [(sum((mine[w] - o[w])**2 // (mine[w] + o[w]) for w in kept), s)
                for (other, s), c in groups.items() if other == lang and s != source for o in [share(c)]]
        part.sort(key=lambda x: (-x[0], x[1].encode()))
        out += [(lang, source, "pair", s, f, i + 1) for i, (f, s) in enumerate(part)]
        best = sorted(((mine[w] - q[w])**2 // (mine[w] + q[w]), w) for w in kept if counts[w] and mine[w] > q[w])
        best.sort(key=lambda x: (-x[0], x[1].encode()))
        out += [(lang, source, "term", w, f, i + 1) for i, (f, w) in enumerate(best[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    rnd = random.Random(11)
    vocab = [rnd.choice("abÀéß漢") * rnd.randint(1, 3) + rnd.choice(["", "prefix", "Pré", "ABCDEFGHIJ" * 4]) + str(i % 7) * (i % 2)
             + rnd.choice(["x", "ü", "𝒳"]) * (i % 5) for i in range(90)]
    long_ = ["q" * 70_000 + "a", "q" * 70_000 + "b"]
    out = []
    for i in range(160):
        words = rnd.choices(vocab, weights=range(1, 91), k=rnd.randint(0, 60))
        if i % 11 == 0:
            words += [long_[i % 2]]
        out.append((i, rnd.choice([" ", "\n", "-", "9", "_"]).join(words), "de" if i % 3 else "fr",
                    f"s{i % 5}" if i % 4 else None, "t", "c", "b", 1))
    out += [out[7]] * 4 + [(None, "abc ABC", None, None, "t", "c", "b", 1), (900, None, None, "only", "", "", "", 2),
                           (901, "", "it", "empty", "", "", "", 2), (902, "!!! 12", "it", "é", "", "", "", 2)]
    return out


def run(df, **kw):
    return sorted(tuple(r) for r in source_divergence(df, **kw).collect())


def test_equals_direct_computation(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(df) == direct(rows)
    # a bitmap so small that most bits are set, many small blocks and groups of terms: the same rows
    assert run(df, bits=1 << 16, block_bytes=400, cells=64) == direct(rows)
    assert run(df, min_docs=3, top=2) == direct(rows, 3, 2)


def test_prefixes_are_refined_until_the_longest_kept_term(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source",
                                                        "coalesce(text, '') text")
    blocks = df.mapInArrow(_blocks(1 << 20), _BLOCK_DDL)
    found, levels = kept_terms(blocks, 5)
    assert levels[:3] == [2, 4, 8] and levels[-1] >= 70_001  # the shared long prefix keeps both long terms alive
    docs = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        docs[lang or ""].update(set(terms(text)))
    want = {(lang, w, n) for lang, c in docs.items() for w, n in c.items() if n >= 5}
    assert {(r["lang"], bytes(r["prefix"]).decode(), r["docs"]) for r in found.collect()} == want
    few = [r for r in rows if len(r[1] or "") < 60_000]
    blocks = spark.createDataFrame(few, SCHEMA).selectExpr("'x' lang", "'y' source", "coalesce(text, '') text") \
        .mapInArrow(_blocks(1 << 20), _BLOCK_DDL)
    assert kept_terms(blocks, 10_000)[1] == [2]  # no prefix reaches the threshold: nothing is extended


def test_empty_and_no_kept_terms(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df.limit(0)) == []
    some = rows[:6]
    assert run(spark.createDataFrame(some, SCHEMA)) == direct(some)
    assert all(r[2] == "pair" and r[4] == 0 for r in direct(some))
