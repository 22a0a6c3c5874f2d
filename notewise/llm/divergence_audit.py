"""Source divergence audit: which terms, and which other sources, set a source apart inside its language.

The vocabulary is found by iceberg prefix refinement.  Texts are tokenised once into
blocks (one language, the distinct terms of every document as local numbers).  Level by
level (2, 4, 8 ... bytes) every block counts the documents of each term prefix; a prefix
with too few documents is discarded with all terms below it, since a longer prefix
never has more documents.  Terms no longer than the level are complete and are kept or
dropped by their own count.  The surviving prefixes travel to the next pass as a bitmap
of ``FILTER_BITS`` bits, whatever their number: a false positive only means that a
prefix is counted once more and dropped then, so the result is exact.

Counts of kept terms are then compared in groups of terms that hold all sources of
their language, as flat integer matrices of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.llm.common import drop, put, release
from notewise.llm.tokens import LOWER, U, buffers, mix, runs

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20
#: Bits of the bitmap of live prefixes (8 MB); fixed, so the broadcast does not grow with the data.
FILTER_BITS = 1 << 26
#: Bits of a piece of the bitmap.
PIECE_BITS = 1 << 16
#: Cells (terms x sources) of a group of terms; languages of many sources take more, up to MOST_CELLS.
CELLS = 1 << 17
MOST_CELLS = 1 << 22
#: Rows that a join on the language alone is split into.
SALTS = 64
#: Cells of the documents x prefixes table that a block marks directly; beyond, pairs are sorted.
MARK_CELLS = 1 << 25

#: Bytes of terms: A-Z, a-z and all bytes of characters from U+0080 on.
_TERM = np.ones(256, bool)
_TERM[:0x80] = False
_TERM[ord("A"):ord("Z") + 1] = True
_TERM[ord("a"):ord("z") + 1] = True
_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, lower-cased, and the text that each stands in."""
    solid = _TERM[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[solid]])])
    return found, np.searchsorted(offsets, starts, side="right") - 1


_BLOCK = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), ("source", pa.binary()),
                    ("size", pa.binary()), ("ids", pa.binary()), ("occ", pa.binary()), ("terms", pa.binary())])
_BLOCK_DDL = "lang string, sources array<string>, source binary, size binary, ids binary, occ binary, terms binary"


def _blocks(block_bytes: int):
    """Tokenise: one row per block and language.

    ``source`` and ``size`` hold, per document, its source's place in ``sources`` and its
    number of distinct terms; ``ids`` and ``occ`` hold, per document and distinct term, the
    step to the term's number and the occurrences; ``terms`` is joined by spaces.
    """
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            sources = batch.column("source").dictionary_encode()
            lang, source = (np.asarray(x.indices) for x in (langs, sources))
            for at, to in runs(offsets, block_bytes):
                near = offsets[at:to + 1] - offsets[at]
                tokens, doc = _tokens(data[offsets[at]:offsets[to]], near)
                coded = tokens.dictionary_encode()
                ids, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
                own = lang[at:to][doc]
                rows = []
                for code in np.unique(own):
                    pairs, occ = np.unique((doc * n + ids)[own == code], return_counts=True)
                    docs, size = np.unique(pairs // n, return_counts=True)
                    used, term = np.unique(pairs % n, return_inverse=True)
                    step = np.diff(term, prepend=0)
                    heads = np.cumsum(size) - size
                    step[heads] = term[heads]
                    names, place = np.unique(source[at + docs], return_inverse=True)
                    rows.append({
                        "lang": langs.dictionary[int(code)].as_py(),
                        "sources": sources.dictionary.take(pa.array(names)).to_pylist(),
                        "source": _zip(place.astype(np.uint32)), "size": _zip(size.astype(np.uint32)),
                        "ids": _zip(step.astype(np.uint32)), "occ": _zip(occ.astype(np.uint32)),
                        "terms": zstandard.ZstdCompressor(level=1).compress(
                            b" ".join(coded.dictionary.take(pa.array(used)).to_pylist()))})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)
    return run


class _Block:
    """A block, unpacked: terms as a binary array, and parallel arrays of (document, term, occurrences)."""

    def __init__(self, row: dict):
        self.lang = row["lang"]
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["terms"]), np.uint8)
        gaps = np.flatnonzero(raw == 0x20)
        self.starts = np.concatenate(([0], gaps + 1))
        self.ends = np.append(gaps, len(raw))
        self.lens = self.ends - self.starts
        self.raw = raw
        bounds = np.concatenate(([0], np.cumsum(self.lens)))
        self.terms = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.lens), [None, pa.py_buffer(bounds), pa.py_buffer(raw[raw != 0x20])])
        size = _unzip(row["size"], np.uint32).astype(np.int64)
        self.docs = len(size)
        self.doc = np.repeat(np.arange(self.docs), size)
        step = _unzip(row["ids"], np.uint32).astype(np.int64)
        total = np.cumsum(step)
        heads = np.cumsum(size) - size
        self.ids = total - np.repeat(total[heads] - step[heads], size)
        self.row = row


def _hash_bits(lang: str, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Bit of every byte string raw[start:end] of a language."""
    up = np.full(len(raw) + 1, _BASE, np.uint64)
    up[0] = 1
    down = np.full(len(raw) + 1, pow(_BASE, -1, 2**64), np.uint64)
    down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_WEIGHTS[raw] * up[:len(raw)], out=sums[1:])
    seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    named = mix((sums[ends] - sums[starts]) * down[starts] + U(seed))
    return (named % U(bits)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _positions(bits: int):
    """Bits of (lang, prefix) rows."""
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("prefix"))
            langs = batch.column("lang").dictionary_encode()
            code = np.asarray(langs.indices)
            at = np.zeros(batch.num_rows, np.int64)
            for k in np.unique(code):
                some = np.flatnonzero(code == k)
                at[some] = _hash_bits(langs.dictionary[int(k)].as_py(), data, offsets[some], offsets[some + 1], bits)
            yield pa.RecordBatch.from_pydict({"piece": at // PIECE_BITS, "bit": (at % PIECE_BITS).astype(np.int32)})
    return run


def _piece(table: pa.Table) -> pa.Table:
    marked = np.zeros(PIECE_BITS, np.uint8)
    marked[table.column("bit").to_numpy()] = 1
    return pa.table({"piece": table.column("piece").slice(0, 1),
                     "bits": pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())})


def _bitmap(live: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the prefixes of ``live``, put together from pieces: at most bits / 8 bytes reach the driver."""
    marked = live.select("lang", "prefix").mapInArrow(_positions(bits), "piece long, bit int").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for row in marked.groupBy("piece").applyInArrow(_piece, "piece long, bits binary").collect():
        at = row["piece"] * (PIECE_BITS // 8)
        out[at:at + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _count(level: int, before: int, live, bits: int):
    """Documents of every prefix of a block at ``level`` bytes, below the live prefixes of ``before`` bytes."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                if before:
                    active = b.lens > before
                    some = np.flatnonzero(active)
                    at = _hash_bits(b.lang, b.raw, b.starts[some], b.starts[some] + before, bits)
                    active[some] = _has(live.value, at)
                    some = np.flatnonzero(active)
                else:
                    some = np.arange(len(b.lens))
                if not len(some):
                    continue
                coded = pc.binary_slice(b.terms.take(pa.array(some)), 0, level).dictionary_encode()
                code = np.asarray(coded.indices).astype(np.int64) * 2 + (b.lens[some] <= level)
                nodes, number = np.unique(code, return_inverse=True)
                node_of = np.full(len(b.lens), -1, np.int64)
                node_of[some] = number
                node = node_of[b.ids]
                hit = node >= 0
                node, doc = node[hit], b.doc[hit]
                if len(nodes) == len(some):  # every prefix has one term here: a document meets it once
                    counts = np.bincount(node, minlength=len(nodes))
                elif b.docs * len(nodes) <= MARK_CELLS:
                    met = np.zeros((b.docs, len(nodes)), bool)
                    met[doc, node] = True
                    counts = met.sum(0)
                else:
                    counts = np.bincount(np.unique(doc * len(nodes) + node) % len(nodes), minlength=len(nodes))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.DictionaryArray.from_arrays(np.zeros(len(nodes), np.int32), [b.lang]).cast(pa.string()),
                    "prefix": coded.dictionary.take(pa.array(nodes >> 1)).cast(pa.binary()),
                    "complete": (nodes & 1).astype(bool), "docs": counts.astype(np.int64)})
    return run


def _occurrences(kept, bits: int):
    """Occurrences of terms per source in a block, for terms whose bit is set."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                ok = _has(kept.value, _hash_bits(b.lang, b.raw, b.starts, b.ends, bits))
                source = _unzip(row["source"], np.uint32).astype(np.int64)
                occ = _unzip(row["occ"], np.uint32).astype(np.int64)
                hit = ok[b.ids]
                n = len(b.lens)
                pair, place = np.unique((source[b.doc] * n + b.ids)[hit], return_inverse=True)
                if not len(pair):
                    continue
                counts = np.zeros(len(pair), np.int64)
                np.add.at(counts, place, occ[hit])
                names = pa.array(row["sources"], pa.string())
                for at in range(0, len(pair), 1 << 17):
                    some = pair[at:at + (1 << 17)]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.DictionaryArray.from_arrays(np.zeros(len(some), np.int32), [b.lang]).cast(pa.string()),
                        "source": names.take(pa.array(some // n)),
                        "term": b.terms.take(pa.array(some % n)).cast(pa.binary()),
                        "count": counts[at:at + (1 << 17)]})
    return run


def kept_terms(blocks: DataFrame, min_docs: int = MIN_DOCS, bits: int = FILTER_BITS) -> tuple[DataFrame, list[int]]:
    """(lang, prefix, docs): the terms in at least ``min_docs`` documents of their language; and the levels taken."""
    sc = blocks.sparkSession.sparkContext
    level, before, live, found, levels = 2, 0, None, None, []
    while True:
        levels.append(level)
        counted = blocks.select("lang", "source", "size", "ids", "terms").mapInArrow(
            _count(level, before, live, bits), "lang string, prefix binary, complete boolean, docs long")
        counted = put(counted.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs"))
                      .filter(F.col("docs") >= min_docs), f"prefixes-{level}")
        if live is not None:
            live.destroy()
        done = counted.filter("complete").select("lang", "prefix", "docs")
        found = done if found is None else found.unionByName(done)
        if not counted.filter("NOT complete").take(1):
            return found, levels
        live = sc.broadcast(_bitmap(counted.filter("NOT complete"), bits))
        level, before = level * 2, level


def _probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly, for count <= total < 2**53: three digits at a time."""
    whole, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return (d * d) // (p + q)


def _compare(top: int):
    """Compare all sources of a language over a group of its terms.

    Rows without a term name the sources, with their totals.  Gives, per pair of
    sources, the sum of the gaps over these terms, and each source's ``top`` terms.
    """
    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table.column("term")))
        body = table.filter(pc.is_valid(table.column("term")))
        order = pc.sort_indices(head.column("source").combine_chunks().cast(pa.binary()))
        head = head.take(order)
        names = head.column("source").combine_chunks()
        total, n_lang = (head.column(c).to_numpy() for c in ("count", "lang_total"))
        vocabulary = int(head.column("terms")[0].as_py())
        terms = body.column("term").combine_chunks().dictionary_encode()
        row = np.asarray(terms.indices).astype(np.int64)
        col = np.asarray(pc.index_in(body.column("source").combine_chunks(), names)).astype(np.int64)
        n, s = len(terms.dictionary), len(names)
        counts = np.zeros((n, s), np.int64)
        counts[row, col] = body.column("count").to_numpy()
        first, second, value, item, owner = [], [], [], [], []
        top_value = []
        if n:
            p = _probability(counts + 2, (total + 2 * vocabulary)[None, :])
            q = _probability(counts.sum(1) + 2, np.full(n, n_lang[0] + 2 * vocabulary))
        for i in range(s):
            if i + 1 < s:
                gaps = _gap(p[:, i + 1:], p[:, i:i + 1]).sum(0) if n else np.zeros(s - i - 1, np.int64)
                first.append(np.full(s - i - 1, i))
                second.append(np.arange(i + 1, s))
                value.append(gaps)
            if not n:
                continue
            some = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            gap = _gap(p[some, i], q[some])
            if len(some) > top:  # all that reach the last of the top values: ties are settled by name later
                least = np.partition(gap, len(gap) - top)[len(gap) - top]
                some, gap = some[gap >= least], gap[gap >= least]
                if len(some) > top:
                    by = sorted(range(len(some)), key=lambda k: (-gap[k], terms.dictionary[int(some[k])].as_py()))[:top]
                    some, gap = some[by], gap[by]
            item.append(some)
            owner.append(np.full(len(some), i))
            top_value.append(gap)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        first, second, value, item, owner, top_value = map(join, (first, second, value, item, owner, top_value))
        items = pa.concat_arrays([names.take(pa.array(second)).cast(pa.string()),
                                  terms.dictionary.take(pa.array(item)).cast(pa.string())])
        rows = len(first) + len(item)
        return pa.table({"lang": pa.array(table.column("lang").slice(0, 1).to_pylist() * rows, pa.string()),
                         "source": names.take(pa.array(np.concatenate((first, owner)))), "item": items,
                         "part": pa.array(["pair"] * len(first) + ["term"] * len(item), pa.string()),
                         "value": pa.array(np.concatenate((value, top_value)), pa.int64())})
    return run


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS, top: int = TOP_TERMS, bits: int = FILTER_BITS,
                      block_bytes: int = BLOCK_BYTES, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs.

    Part ``pair``: every other source of the language, by the summed gap of smoothed
    term shares; part ``term``: the source's ``top`` terms above the language's share.
    Null texts, languages and sources count as empty; every row is one document, repeated
    rows and null ids included; other columns are not read.  A group without terms has all
    its pairs; where a language keeps no term every pair has value 0.  An empty table
    gives no rows.  A term is compared over whole texts, however long.
    """
    spark = docs.sparkSession
    text = lambda c, out: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(out)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    groups = put(rows.select("lang", "source").distinct(), "groups")
    blocks = put(rows.mapInArrow(_blocks(block_bytes), _BLOCK_DDL), "blocks")
    kept, _ = kept_terms(blocks, min_docs, bits)
    release(spark)

    # groups of terms of a language, each of about `cells` terms x sources
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left") \
        .select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "n_sources")
    langs = put(langs.withColumn("buckets", (F.lit(1) + F.expr(
        f"(terms * n_sources) div greatest({int(cells)}, least({MOST_CELLS}, 4 * n_sources * n_sources))")).cast("long")),
                "langs")
    salt = F.pmod(F.xxhash64("prefix"), F.lit(SALTS)).cast("int")
    kept = kept.withColumn("salt", salt).join(
        langs.select("lang", "buckets", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")),
        ["lang", "salt"]).select("lang", F.col("prefix").alias("term"),
                                 F.pmod(F.xxhash64(F.lit(1), "prefix"), "buckets").alias("bucket"))
    kept = put(kept, "kept")
    bitmap = spark.sparkContext.broadcast(_bitmap(kept.select("lang", F.col("term").alias("prefix")), bits))
    counts = blocks.mapInArrow(_occurrences(bitmap, bits), "lang string, source string, term binary, count long") \
        .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    counts = put(counts.join(kept, ["lang", "term"]), "counts")
    bitmap.destroy()
    drop(blocks)
    release(spark)

    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("count").alias("count")), ["lang", "source"], "left") \
        .select("lang", "source", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    totals = put(totals, "totals")
    heads = totals.join(totals.groupBy("lang").agg(F.sum("count").alias("lang_total")), "lang").join(langs, "lang") \
        .select("lang", F.explode(F.expr("sequence(0L, buckets - 1L)")).alias("bucket"), "source",
                F.lit(None).cast("binary").alias("term"), "count", "lang_total", "terms")
    body = counts.select("lang", "bucket", "source", "term", "count", F.lit(None).cast("long").alias("lang_total"),
                         F.lit(None).cast("long").alias("terms"))
    found = heads.unionByName(body).groupBy("lang", "bucket").applyInArrow(
        _compare(top), "lang string, source string, item string, part string, value long")
    found = put(found, "compared")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = found.filter("part = 'term'").select("lang", "source", "item", "value") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")) \
        .unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"),
                      F.col("rank").cast("int").alias("rank"))
