"""N-gram Jaccard join with prefix filters under several global orders.

A document's set holds the fingerprints of its distinct 5-word shingles.  At
Jaccard 0.75 a set of n shingles shares at least ceil(0.75 n) with any partner, so
under any global order of shingles the first n - ceil(0.75 n) + 1 of both sets have
one in common.  Three orders are used: (1) shingles known to be frequent last, the
rest by fingerprint; (2) and (3) two further random orders.  Order 1 finds
candidates through an inverted index of prefixes; a candidate must then also share
prefix shingles under orders 2 and 3, and only the pairs that pass all three are
verified on the whole sets.

Equal sets are one set with several documents.  The result needs the classes, not
every pair, so a posting list first links its members to its smallest member.  Lists
whose members then lie in several classes are compared across classes, twice: the
first pass checks a spanning forest of the closest pairs, which merges most classes,
the second all pairs that are left between classes, which loses no link.  Lists of
frequent shingles are split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import components, drop, empty, fresh, put, release
from notewise.llm.tokens import U, buffers, mix, runs, shingles

WORDS = 5
#: Jaccard at least 75 / 100.
PER_CENT = 75
#: Counters of a task's summary of frequent shingles, and frequent shingles that order 1 knows at most.
COUNTERS = 65_536
FREQUENT = 100_000
#: Documents from which a shingle counts as frequent.
FREQUENT_FROM = 64
#: Postings of a bucket on average (some 100 bytes each while its lists are compared), and members of a posting list
#: that one task handles.
BUCKET = 250_000
LIST = 50_000
#: Members of a list that are compared with one another at once, and bitmap bytes of a group of such blocks on average.
BLOCK = 2_048
GROUP_BYTES = 4 << 20
#: Least and most cells of the parity bitmap that rules out far pairs before the filters of orders 2 and 3; a set has
#: at least one cell a shingle between these.
BITS, MOST_BITS = 512, 32_768
#: Bytes of joined rows that are compared at once.
SLICE_BYTES = 8 << 20
#: Ids that are broadcast at most to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SECOND, _THIRD = U(0x6A09E667F3BCC908), U(0xBB67AE8584CAA73B)


def required(n):
    """Least overlap of a set of n with any partner: ceil(PER_CENT * n / 100)."""
    return (n * PER_CENT + 99) // 100


def prefix_size(n):
    return n - required(n) + 1


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= PER_CENT * (a + b - both)


class Sets:
    """Shingle sets of consecutive texts: sorted fingerprints (63 bits), row starts, sizes, signatures."""

    def __init__(self, data, offsets, k: int = WORDS):
        h, row = shingles(data, offsets, k)
        h = h >> U(1)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
        self.h, self.row = h, row
        self.n = np.bincount(row, minlength=len(offsets) - 1)
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h), out=sums[1:])
        # one signature per set; sets of other sizes or members differ but for a chance of 2^-64 a pair
        self.sig = mix(sums[self.starts[1:]] - sums[self.starts[:-1]] + self.n.astype(np.uint64)).astype(np.int64)

    def prefixes(self, key: np.ndarray, rows: np.ndarray):
        """Positions of the prefix shingles of ``rows`` (flags) by rising ``key``."""
        order = np.lexsort((key, self.row))
        rank = np.arange(len(order)) - self.starts[self.row[order]]
        take = (rank < prefix_size(self.n)[self.row[order]]) & rows[self.row[order]]
        return order[take]


def _texts(batch):
    data, offsets = buffers(batch.column(1))
    for a, b in runs(offsets):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


class Frequent:
    """Misra-Gries summary: every item with more than rows / COUNTERS occurrences stays, counts never too high."""

    def __init__(self, counters: int = COUNTERS):
        self.size, self.items, self.counts = counters, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, items: np.ndarray):
        self.waiting.append(items)
        self.held += len(items)
        if self.held > 1 << 18:
            self.merge()

    def merge(self):
        if not self.waiting:
            return
        fresh, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.held = [], 0
        every, back = np.unique(np.concatenate([self.items, fresh]), return_inverse=True)
        total = np.bincount(back, np.concatenate([self.counts, counts]), len(every)).astype(np.int64)
        if len(every) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
        keep = total > 0
        self.items, self.counts = every[keep], total[keep]


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("bits", pa.binary()),
                      ("item", pa.int64()), ("uses", pa.int64())])


def _fresh(s: Sets, seen: set) -> np.ndarray:
    """Flags of the non-empty sets that a task meets for the first time."""
    fresh = np.zeros(len(s.n), bool)
    for i, (sig, n) in enumerate(zip(s.sig.tolist(), s.n.tolist(), strict=True)):
        if n and sig not in seen:
            seen.add(sig)
            fresh[i] = True
    return fresh


def _parities(h: np.ndarray) -> bytes:
    """For each of a power of two of cells, whether an odd number of the set's shingles fall into it.

    Cells that differ between two sets are no more than the shingles that only one holds.
    """
    cells = min(MOST_BITS, max(BITS, 1 << (len(h) - 1).bit_length()))
    odd = np.bincount((h & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes of the same set: cells that fall together add their parities."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _profile(k: int):
    def run(batches):
        summary, seen = Frequent(), set()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in _texts(batch):
                s = Sets(data, offsets, k)
                summary.add(s.h)
                none = pa.nulls(b - a, pa.int64())
                bits = [_parities(s.h[s.starts[i]:s.starts[i + 1]]) if new else None
                        for i, new in enumerate(_fresh(s, seen))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(s.n, pa.int64()), pa.array(s.sig),
                                                  pa.array(bits, pa.binary()), none, none], schema=_PROFILE)
        summary.merge()
        keep = summary.counts > 1
        none = pa.nulls(int(keep.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()),
                                          pa.array(summary.items[keep].astype(np.int64)),
                                          pa.array(summary.counts[keep])], schema=_PROFILE)
    return run


def _rank(frequent, tokens: np.ndarray) -> np.ndarray:
    """Place of each token among the frequent ones (by rising use), or -1."""
    items, places, _ = frequent
    if not len(items):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(items, tokens), len(items) - 1)
    return np.where(items[at] == tokens, places[at], -1)


def _salt(frequent, tokens: np.ndarray, sig: np.ndarray, most: int) -> np.ndarray:
    """Part of a token's posting list that a document goes to; 0 but for lists longer than ``most``."""
    out = np.zeros(len(tokens), np.int64)
    items, _, uses = frequent
    if len(items):
        at = np.minimum(np.searchsorted(items, tokens), len(items) - 1)
        parts = np.where(items[at] == tokens, -(-uses[at] // most), 1)
        many = parts > 1
        out[many] = mix(sig[many].astype(np.uint64) ^ tokens[many]) % parts[many].astype(np.uint64)
    return out


def _postings(shared, n_buckets: int, k: int, most: int):
    def run(batches):
        frequent = shared.value
        seen: set = set()
        held, size = [], 0

        def flush():
            tok, sig, n = (np.concatenate(x) for x in zip(*held, strict=True))
            salt = _salt(frequent, tok, sig, most)
            to = (mix(tok + salt.astype(np.uint64)) >> U(20)) % U(n_buckets)
            order = np.argsort(to, kind="stable")
            to, tok, sig, n = to[order], tok[order], sig[order], n[order]
            cut = np.append(np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))), len(to))
            blobs = [tok[a:b].tobytes() + sig[a:b].tobytes() + n[a:b].tobytes()
                     for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())],
                                              names=["bucket", "blob"])

        for batch in batches:
            for _, _, data, offsets in _texts(batch):
                s = Sets(data, offsets, k)
                fresh = _fresh(s, seen)
                place = _rank(frequent, s.h)
                key = np.where(place >= 0, U(1 << 63) + place.astype(np.uint64), s.h)
                at = s.prefixes(key, fresh)
                held.append((s.h[at], s.sig[s.row[at]], s.n[s.row[at]].astype(np.int32)))
                size += len(at)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    return run


_CANDIDATES = "kind int, x long, y long, nx int, ny int"


def _candidates(shared, most: int):
    """kind 0: pairs (x, y) to check; 1: member y (size ny) of list x; 2: smallest member y of a part of list x."""
    def run(table: pa.Table) -> pa.Table:
        tok, sig, size = [], [], []
        for blob in table.column("blob").to_pylist():
            m = len(blob) // 20
            tok.append(np.frombuffer(blob, np.uint64, m))
            sig.append(np.frombuffer(blob, np.int64, m, 8 * m))
            size.append(np.frombuffer(blob, np.int32, m, 16 * m))
        tok, sig, size = np.concatenate(tok), np.concatenate(sig), np.concatenate(size)
        salt = _salt(shared.value, tok, sig, most)
        order = np.lexsort((sig, salt, tok))
        tok, sig, size, salt = tok[order], sig[order], size[order], salt[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        fresh = new.copy()
        fresh[1:] |= sig[1:] != sig[:-1]
        tok, sig, size, salt, new = tok[fresh], sig[fresh], size[fresh], salt[fresh], new[fresh]
        starts = np.flatnonzero(new)
        m = np.diff(np.append(starts, len(tok)))
        lists = np.repeat(np.arange(len(starts)), m)
        items, _, uses = shared.value
        split = np.zeros(len(starts), bool)
        if len(items):
            at = np.minimum(np.searchsorted(items, tok[starts]), len(items) - 1)
            split = (items[at] == tok[starts]) & (uses[at] > most)
        # pairs with the smallest signature of the list
        low, low_n = sig[starts][lists], size[starts][lists]
        pair = (sig != low) & fits(low_n, size)
        pairs = np.unique(np.column_stack([low[pair], sig[pair], low_n[pair], size[pair]]), axis=0)
        # members of longer lists; lists with the same members are one
        sums = np.add.reduceat(mix(sig.astype(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
        name = np.where(split, tok[starts], mix(sums + m.astype(np.uint64))).astype(np.int64)
        _, first = np.unique(name, return_index=True)
        pick = np.zeros(len(starts), bool)
        pick[first] = True
        pick = (pick & (m > 2)) | split
        at = np.flatnonzero(pick[lists])
        parts = np.flatnonzero(split)
        kind = np.concatenate([np.zeros(len(pairs)), np.ones(len(at)), np.full(len(parts), 2)]).astype(np.int32)
        x = np.concatenate([pairs[:, 0], name[lists[at]], name[parts]])
        y = np.concatenate([pairs[:, 1], sig[at], sig[starts[parts]]])
        nx = np.concatenate([pairs[:, 2], np.zeros(len(at) + len(parts), np.int64)]).astype(np.int32)
        ny = np.concatenate([pairs[:, 3], size[at], size[starts[parts]]]).astype(np.int32)
        return pa.table({"kind": kind, "x": x, "y": y, "nx": nx, "ny": ny})
    return run


def fits(a, b):
    """Length filter: sizes of a pair that can reach the threshold."""
    return 100 * np.minimum(a, b).astype(np.int64) >= PER_CENT * np.maximum(a, b).astype(np.int64)


def margin(n):
    """Shingles that a pair must share in the longer prefixes of orders 2 and 3.

    With m more shingles, the prefixes of any linked pair share m + 1: leaving out the last
    required(n) - 1 - m of a set leaves out at most so many of the shared ones.
    """
    return 1 + n // 8


def _lowest(key: np.ndarray) -> bytes:
    """Longer prefix under the order of ``key``: the upper halves of its least values, sorted.

    Another shingle may look the same in the upper half, a shared one never differs.
    """
    p = min(len(key), prefix_size(len(key)) - 1 + margin(len(key)))
    key = key if p >= len(key) else np.partition(key, p - 1)[:p]
    return np.sort(key >> U(32)).astype(np.uint32).tobytes()


def _sets(batches, k: int):
    for batch in batches:
        for _, _, data, offsets in _texts(batch):
            s = Sets(data, offsets, k)
            rows = np.flatnonzero(s.n)
            yield s, rows, [s.h[s.starts[i]:s.starts[i + 1]] for i in rows]


_STORED = "sig long, n long, second binary, third binary, members binary"


def _stored(k: int):
    """Prefixes under orders 2 and 3 and the whole sets."""
    def run(batches):
        for s, rows, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.sig[rows]), pa.array(s.n[rows], pa.int64()),
                 *(pa.array([_lowest(mix(h ^ order)) for h in sets], pa.binary()) for order in (_SECOND, _THIRD)),
                 pa.array([h.tobytes() for h in sets], pa.binary())], names=["sig", "n", "second", "third", "members"])
    return run


def _overlap(a: bytes, b: bytes, kind) -> int:
    a, b = np.frombuffer(a, kind), np.frombuffer(b, kind)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _small(batches):
    """The batches in slices of about SLICE_BYTES; memory that Arrow keeps is given back at the end."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def _close(batches):
    """Pairs whose parities differ in no more cells than shingles may: na + nb - 2 * least overlap."""
    for batch in _small(batches):
        n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
        left, right = batch.column(3).to_pylist(), batch.column(5).to_pylist()
        width = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], int)
        apart = np.zeros(len(n), np.int64)
        for size in np.unique(width).tolist():
            at = np.flatnonzero(width == size)
            apart[at] = _differ(*(np.array([_folded(side[i], size) for i in at]) for side in (left, right)))
        least = -(-PER_CENT * n // (100 + PER_CENT))
        yield batch.select([0, 1]).filter(pa.array(apart <= n - 2 * least))


def _forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Edges (positions) of a minimum spanning forest over the classes ``group`` of the ends, by Boruvka's steps."""
    _, ends = np.unique(np.concatenate([group[x], group[y]]), return_inverse=True)
    order = np.argsort(weight, kind="stable")
    u, v = ends[:len(x)][order], ends[len(x):][order]
    root, left, picked = np.arange(int(ends.max(initial=-1)) + 1), np.arange(len(x)), []
    while True:
        left = left[root[u[left]] != root[v[left]]]
        if not len(left):
            return order[np.unique(np.concatenate(picked))] if picked else left
        best = np.full(len(root), len(x))
        np.minimum.at(best, root[u[left]], left)
        np.minimum.at(best, root[v[left]], left)
        edge = np.unique(best[best < len(x)])
        picked.append(edge)
        p, q, label = root[u[edge]], root[v[edge]], np.arange(len(root))
        while (label[p] != label[q]).any():
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            label = label[label]
        root = label[root]


def _across(forest: bool):
    """Pairs of one list, from different classes, whose sizes and parities allow a link; a block pair at a time.

    With ``forest`` only the closest pairs that span the classes of a block pair.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("low", "ascending"), ("high", "ascending"),
                               ("sig", "ascending")])
        col = {c: table.column(c).to_numpy() for c in ("list", "low", "high", "block", "sig", "n", "class")}
        bits = table.column("bits").to_pylist()
        new = np.ones(table.num_rows, bool)
        del table
        width = np.array([len(x) for x in bits], int)
        new[1:] = (np.diff(col["list"]) != 0) | (np.diff(col["low"]) != 0) | (np.diff(col["high"]) != 0)
        starts = np.append(np.flatnonzero(new), len(new))
        none = np.zeros(0, np.int64)
        left, right = [none], [none]
        for a, b in zip(starts, starts[1:], strict=False):
            sig, n, group = col["sig"][a:b], col["n"][a:b], col["class"][a:b]
            cross, wide = col["low"][a] != col["high"][a], width[a:b]
            # sets of a pair are of similar size, so their bitmaps are as wide or one is twice the other
            folded, place = {}, {}
            for size in np.unique(wide).tolist():
                held = np.flatnonzero((wide == size) | (wide == 2 * size))
                folded[size] = np.array([_folded(bits[a + i], size) for i in held])
                place[size] = np.zeros(b - a, np.int64)
                place[size][held] = np.arange(len(held))
            x_of, y_of, far = none, none, np.zeros(0)
            for at in range(0, b - a, 256):
                s = slice(at, at + 256)
                want = (group[s, None] != group) & fits(n[s, None], n) & (sig[s, None] < sig)
                if cross:
                    want &= col["block"][a:b][s, None] != col["block"][a:b]
                x, y = np.nonzero(want)
                x += at
                both = np.minimum(wide[x], wide[y])
                for size in np.unique(both).tolist():
                    here, step = np.flatnonzero(both == size), (8 << 20) // size
                    for p in range(0, len(here), step):
                        i, j = x[here[p:p + step]], y[here[p:p + step]]
                        total = n[i] + n[j]
                        apart = _differ(folded[size][place[size][i]], folded[size][place[size][j]])
                        keep = apart <= total - 2 * -(-PER_CENT * total // (100 + PER_CENT))
                        x_of, y_of = np.append(x_of, i[keep]), np.append(y_of, j[keep])
                        far = np.append(far, (apart / total)[keep])
                        if forest:
                            span = _forest(x_of, y_of, far, group)
                            x_of, y_of, far = x_of[span], y_of[span], far[span]
                if not forest:
                    left.append(sig[x_of])
                    right.append(sig[y_of])
                    x_of, y_of, far = none, none, np.zeros(0)
            left.append(sig[x_of])
            right.append(sig[y_of])
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
    return run


def _share_second(batches):
    for batch in _small(batches):
        keep = [_overlap(p, q, np.uint32) >= min(margin(m), margin(n))
                for m, p, n, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(batches):
    """The third order's filter, then the whole sets."""
    for batch in _small(batches):
        keep = [_overlap(p, q, np.uint32) >= min(margin(len(x) // 8), margin(len(y) // 8))
                and linked(_overlap(x, y, np.uint64), len(x) // 8, len(y) // 8)
                for p, x, q, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _some(ids: DataFrame) -> DataFrame:
    """``ids``, written once, and to be broadcast only if there are no more than BROADCAST_IDS."""
    ids = put(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _fetch(docs: DataFrame, rows: DataFrame, sigs: DataFrame, k: int) -> DataFrame:
    """Prefixes and whole set of one document of every signature in ``sigs``."""
    need = rows.join(sigs.distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("need_id")) \
        .select("need_id").distinct()
    out = put(docs.join(_some(need), F.col("doc_id").eqNullSafe(F.col("need_id")), "left_semi")
              .mapInArrow(_stored(k), _STORED), "sets")
    release(docs.sparkSession)
    return out


def _both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` for either side."""
    for at in ("a", "b"):
        pairs = pairs.join(table.select(F.col("sig").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in
                                                                  table.columns if c != "sig"]), at)
    return pairs.select("a", "b", *[f"{at}_{c}" for at in ("a", "b") for c in table.columns if c != "sig"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))


def _links(docs: DataFrame, rows: DataFrame, close: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) that also share prefixes under orders 2 and 3 and reach the threshold."""
    sets = _fetch(docs, rows, _ends(close), k)
    passed = put(_both(close, sets.select("sig", "n", "second")).mapInArrow(_share_second, "a long, b long"),
                 "passed")
    release(docs.sparkSession)
    links = put(_both(passed, sets.select("sig", "third", "members")).mapInArrow(_verify, "a long, b long"), "links")
    drop(passed, sets)
    release(docs.sparkSession)
    return links


def _mixed_pairs(lists: DataFrame, classes: DataFrame, bits: DataFrame, forest: bool) -> DataFrame | None:
    """Pairs that :func:`_across` finds in the lists whose members lie in several classes; None without such lists."""
    members = lists.join(classes.withColumnRenamed("id", "sig"), "sig", "left") \
        .select("list", "sig", "n", F.coalesce("component", "sig").alias("class"))
    mixed = members.groupBy("list").agg(F.min("class").alias("lo"), F.max("class").alias("hi"),
                                        F.count("*").alias("m")).filter("lo != hi")
    sizes = put(mixed.select("list", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("blocks"), "m"), "sizes")
    if empty(sizes):
        return None
    rows_out = sizes.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0]
    bytes_out = int(rows_out * (bits.agg(F.avg(F.octet_length("bits"))).first()[0] or 0))
    laid = members.join(sizes.select("list", "blocks"), "list") \
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")) \
        .join(bits.select("sig", "bits"), "sig") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")) \
        .withColumn("group", F.pmod(F.xxhash64("list", "low", "high"), F.lit(1 + bytes_out // GROUP_BYTES)))
    return laid.select("group", "list", "low", "high", "block", "sig", "n", "class", "bits") \
        .groupBy("group").applyInArrow(_across(forest), "a long, b long").distinct()


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
               list_size: int = LIST, bucket_size: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct
    k-word shingles (with fewer words, the whole sequence is the one shingle).
    ``component_id`` is the smallest doc_id that is reachable by links, the own one
    included.  A text that is null or has no words has an empty set and links with
    nothing.  Rows that repeat an id are rows like others.  No rows in, no rows out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = put(docs.mapInArrow(_profile(k), "doc_id long, n long, sig long, bits binary, item long, uses long"),
                  "profile")
    rows = profile.filter("n IS NOT NULL").select("doc_id", "n", "sig")
    top = profile.filter("item IS NOT NULL").groupBy("item").agg(F.sum("uses").alias("uses")) \
        .filter(F.col("uses") >= FREQUENT_FROM).orderBy(F.desc("uses"), "item").limit(FREQUENT).toPandas()
    top = top.sort_values(["uses", "item"], ignore_index=True)
    items = top["item"].to_numpy().astype(np.uint64)
    order = np.argsort(items)
    frequent = spark.sparkContext.broadcast(  # FREQUENT entries at most
        (items[order], order.astype(np.int64), top["uses"].to_numpy().astype(np.int64)[order]))
    n = F.col("n")
    total = rows.agg(F.sum(n - F.floor((n * PER_CENT + 99) / 100) + 1)).first()[0] or 0
    n_buckets = 1 + int(total) // bucket_size

    found = docs.mapInArrow(_postings(frequent, n_buckets, k, list_size), "bucket long, blob binary") \
        .groupBy("bucket").applyInArrow(_candidates(frequent, list_size), _CANDIDATES)
    found = put(found, "candidates")
    release(spark)
    parts = found.filter("kind = 2").select("x", "y", "ny").distinct()
    heads = parts.groupBy("x").agg(F.min(F.struct("y", "ny")).alias("head"))
    pairs = found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "nx", "ny") \
        .union(parts.join(heads, "x").filter("y != head.y").select(F.col("head.y").alias("a"), F.col("y").alias("b"),
                                                                F.col("head.ny").alias("nx"), "ny")) \
        .filter(_fits_sql("nx", "ny")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    lists = put(found.filter("kind = 1").select(F.col("x").alias("list"), F.col("y").alias("sig"),
                                                F.col("ny").alias("n")).distinct(), "lists")
    pairs = put(pairs, "pairs")

    bits = put(profile.filter("bits IS NOT NULL").select("sig", "n", "bits").dropDuplicates(["sig"]), "bits")
    close = put(_both(pairs, bits).mapInArrow(_close, "a long, b long"), "close")
    links = _links(docs, rows, close, k)
    classes = put(components(links), "classes")

    # lists whose members lie in several classes: pairs across classes, first those that span them, then all
    for forest in (True, False):
        more = _mixed_pairs(lists, classes, bits, forest)
        if more is None:
            break
        more = put(more.join(pairs, ["a", "b"], "left_anti"), "more")
        if empty(more):
            continue
        pairs, links = pairs.union(more), links.union(_links(docs, rows, more, k))
        classes = put(components(links), "classes")
    drop(found, bits, close)

    owned = rows.join(classes.withColumnRenamed("id", "sig"), "sig", "left") \
        .withColumn("class", F.coalesce("component", "sig"))
    owned = put(owned.filter("n > 0").select("doc_id", "n", "class"), "owned")
    lowest = owned.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return owned.join(lowest, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _fits_sql(a: str, b: str) -> str:
    return f"100 * CAST(least({a}, {b}) AS BIGINT) >= {PER_CENT} * CAST(greatest({a}, {b}) AS BIGINT)"


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each component (the smallest id), with all their columns.

    Rows that repeat an id stay or go together: they stay where one of them is its
    component's smallest.  Columns of any name pass through.
    """
    gone_id = fresh("gone_id")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = ngram_join(docs, id_col, text_col).groupBy(F.col("doc_id").alias(gone_id)) \
        .agg(F.max(mine).alias("stays")).filter("NOT stays").select(gone_id)
    gone = _some(gone)
    release(docs.sparkSession)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
