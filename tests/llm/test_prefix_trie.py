"""The prefix trie against a direct computation, and the perfect hash on its own."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from notewise.llm import prefix_trie as pt
from notewise.session import ship_package

SCHEMA = "conv_id long, turn long, role string, text string, shard string, depth string, d1 string, rank long"


def ident(role, text):
    whole = f"{len(role.encode())}:{role}:{text}"
    raw = hashlib.sha256(whole.encode()).digest()
    return [int.from_bytes(raw[i:i + 8], "big", signed=True) for i in (0, 8)]


def rem(a, b):
    """Remainder with the sign of the dividend, as in SQL."""
    return a - b * int(a / b)


def direct(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role.encode(), ident(role, text), role, text))
    convs = {c: [x[-2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(convs.get(c - rem(c, 5), [])[:h] + convs[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        value = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += value
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


def run(df, **kw):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in pt.prefix_trie(df, **kw).collect())


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    rnd = random.Random(13)
    extra = ("x", "y", "z", 1)
    out = []
    for c in range(-12, 90):
        if rnd.random() < 0.15:
            continue  # absent, bases among them
        words = [rnd.choice(["a", "b", "é漢", ""]) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14]))]
        out += [(c, t if t else None, rnd.choice(["user", "user", None]), w, *extra) for t, w in enumerate(words)]
    for c in range(200, 240):  # copies
        out += [(c, t, "user", f"same {t}", *extra) for t in range(12)]
    long_ = [(t, "user", f"long {t % 7}") for t in range(60)]
    for c in (300, 305, 310):  # long ones, with tails of their own
        out += [(c, *x, *extra) for x in long_] + [(c, 60 + t, "user", f"tail {c}", *extra) for t in range(c - 299)]
    out += [(400, 5, "user", x, *extra) for x in ("tie", "tie", "tied", "", None)] * 2  # equal turns and repeated rows
    out += [(None, 1, "user", "no id", *extra), (7001, 1, "user", None, *extra), (405, 1, None, "w " * 100_000, *extra)]
    return out


def test_equals_direct_computation(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = direct(rows)
    assert any(r[1] == 0 for r in want)
    assert run(df) == want
    # many shards, and bands that cut long conversations
    assert run(df, shard_rows=20, band=4) == want
    assert run(df, shard_rows=7, band=1) == want


def test_turnless_conversations_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    some = [r for r in rows if r[0] == 7001]  # no base, and crc32('7001') % 9 turns are lent by none
    assert zlib.crc32(b"7001") % 9 > 0
    assert run(spark.createDataFrame(some, SCHEMA)) == direct(some)
    assert run(df.limit(0)) == []
    assert run(df.filter("conv_id IS NULL")) == []


def test_ends_over_many_pieces(spark, monkeypatch):
    rows = [(i % 3, 7, c) for i, c in enumerate(random.Random(1).sample(range(-5_000, 90_000), 60_000))]
    got = {(r["d1"], r["d2"]): r["ends_sha256"] for r in pt.end_digests(
        spark.createDataFrame(rows, "d1 long, d2 long, conv_id long").repartition(6)).collect()}
    for d in range(3):
        ids = sorted(c for a, _, c in rows if a == d)
        assert got[d, 7] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash_is_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    d = rng.integers(0, 2**64 - 1, (2, n + 100), dtype=np.uint64)
    d[0, :n // 2] = 5  # digests that share a word
    table = pt.PerfectHash(d[0, :n], d[1, :n])
    assert sorted(table.slot.tolist()) == list(range(n))
    assert (table.find(d[0, :n], d[1, :n]) == table.slot).all()
    assert (table.find(d[0, n:], d[1, n:]) == -1).all()
    if n:
        with pytest.raises(RuntimeError):
            pt.PerfectHash(np.append(d[0, :n], d[0, 0]), np.append(d[1, :n], d[1, 0]))
