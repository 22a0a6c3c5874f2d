"""Trie of the prefixes of conversations, as node tables under minimal perfect hashes.

1. Turns are put in order without gathering a conversation (:func:`_pieces`); only a
   digest of role and text, and the text's bytes, go on.
2. Conversations are rebuilt, and every prefix gets a 128-bit digest: the running XOR of
   its turns' digests, each hashed with its place.  It runs inside the piece of a
   conversation that lies in one partition; a row per piece carries it on to the next.
3. Prefixes are dealt to shards of bounded size by conversation, and by bands of ``BAND``
   turns, for endless ones.  A shard enumerates its distinct digests and gives each a
   slot of a minimal perfect hash: level by level, digests that meet no other in a bit
   array keep their place and collided ones go on to the next level, so that slots are
   verified and gapless.  Counts are scattered into flat arrays by slot, and each node
   holds its parent's slot.
4. Nodes of all shards are merged by digest.  Digests that agree for different turns,
   parents or depths show here and raise.
5. A node is owned by the shard of its smallest member, whose path holds its ancestors.
   Every shard scatters the values of the nodes it owns and accumulates them through the
   parent slots, deepest first; the shards' sums add up to the whole subtree, so no
   subtree has to lie in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.llm.common import drop, put, release
from notewise.llm.tokens import U, mix

#: The first turns come from the first of each ``FAMILY`` ids, as many as crc32 of the id modulo ``MOST``.
FAMILY = 5
MOST = 9
#: Prefixes of a shard on average.
SHARD_ROWS = 200_000
#: Turns of a conversation that lie in one shard.
BAND = 4_096
#: Bytes of joined ids in a piece of a node's ends.
END_BYTES = 1 << 20
#: Bits of a level of the hash for each digest.
GAMMA = 2
MAX_LEVELS = 64


def _pieces(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based ``rank`` of each row in its key, and the ``piece`` (partition) it lies in.

    Rows are range-partitioned by key and order, so a key of any size is cut into pieces of the size of a
    partition; a row per piece and key gives the offsets.  Ends hash-partitioned by (piece, key).
    """
    laid = put(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
               .withColumn("piece", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), name)
    sizes = laid.groupBy("piece", key).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("piece", key, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return laid.join(sizes, ["piece", key]) \
        .withColumn("rank", (F.col("row") - F.col("first") + F.col("before")).cast("long")).drop("row", "first", "before")


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, t1, t2, bytes) of the rebuilt conversations, places with gaps; (conv_id) of all)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                                 text("role"), text("text")).filter("conv_id IS NOT NULL")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text"))
    word = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    turns = turns.withColumn("sha", F.sha2(whole, 256)).select(
        "conv_id", "turn", "role", word(1).alias("t1"), word(17).alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))
    turns = put(turns, "turns")
    ranked = put(_pieces(turns, "conv_id", ["turn", "role", "t1", "t2"], "ordered")
                 .select("conv_id", F.col("rank").alias("pos"), "t1", "t2", "bytes"), "ranked")
    drop(turns)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    convs = put(ranked.select("conv_id").distinct(), "convs")
    lent = ranked.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base").join(
        convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % F.lit(family)).alias("base"), taken.alias("h")),
        "base").filter("pos < h").select("conv_id", "pos", "t1", "t2", "bytes")
    own = ranked.filter(F.col("pos") >= taken).select("conv_id", "pos", "t1", "t2", "bytes")
    return lent.unionByName(own), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """Per (conv_id, pos) its prefix: conv_id, depth (from 1, gapless), d1 d2, parent p1 p2, last turn t1 t2 bytes."""
    turns = put(turns, "rebuilt")
    rows = _pieces(turns, "conv_id", ["pos"], "laid").withColumn("depth", F.col("rank") + 1) \
        .withColumn("m1", F.xxhash64("t1", "depth", "t2")).withColumn("m2", F.xxhash64("t2", F.lit(2), "t1", "depth"))
    inside = Window.partitionBy("piece", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = put(rows.select("piece", "conv_id", "depth", "t1", "t2", "bytes", "m1", "m2",
                           F.bit_xor("m1").over(inside).alias("s1"), F.bit_xor("m2").over(inside).alias("s2")), "running")
    drop(turns)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("piece", "conv_id").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    parts = parts.select("piece", "conv_id", F.bit_xor("m1").over(before).alias("o1"),
                         F.bit_xor("m2").over(before).alias("o2")).filter("o1 IS NOT NULL")
    zero = F.lit(0).cast("long")
    out = rows.join(parts, ["piece", "conv_id"], "left") \
        .withColumn("d1", F.col("s1").bitwiseXOR(F.coalesce("o1", zero))) \
        .withColumn("d2", F.col("s2").bitwiseXOR(F.coalesce("o2", zero)))
    return out.select("conv_id", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("m1")).alias("p1"),
                      F.col("d2").bitwiseXOR(F.col("m2")).alias("p2"), "t1", "t2", "bytes")


class PerfectHash:
    """Minimal perfect hash of distinct digests (two uint64 arrays): slots 0 to n - 1."""

    def __init__(self, d1: np.ndarray, d2: np.ndarray):
        self.levels, self.n = [], len(d1)
        left, base = np.arange(len(d1)), 0
        self.slot = np.full(len(d1), -1, np.int64)
        while len(left):
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("digests are not distinct")
            size = GAMMA * len(left)
            at = self._place(d1[left], d2[left], size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            placed = alone[at]
            self.slot[left[placed]] = base + rank[at[placed]]
            self.levels.append((size, alone, rank + base))
            base += int(alone.sum())
            left = left[~placed]
        self.d1, self.d2 = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        self.d1[self.slot], self.d2[self.slot] = d1, d2

    def _place(self, d1, d2, size, level=None):
        salt = U(len(self.levels) if level is None else level)
        return (mix(d1 + mix(d2 + salt)) % U(size)).astype(np.int64)

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Slots of digests, verified; -1 for those that are not in the set."""
        out = np.full(len(d1), -1, np.int64)
        for level, (size, alone, slot) in enumerate(self.levels):
            some = np.flatnonzero(out < 0)
            at = self._place(d1[some], d2[some], size, level)
            hit = alone[at]
            out[some[hit]] = slot[at[hit]]
        known = out >= 0
        known[known] = (self.d1[out[known]] == d1[known]) & (self.d2[out[known]] == d2[known])
        return np.where(known, out, -1)


def _u64(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in names]


_NODE = ("shard long, slot long, parent_slot long, d1 long, d2 long, p1 long, p2 long, t1 long, t2 long, depth long, "
         "bytes long, n_local long, min_conv long")


def _node_table(band: int):
    """Distinct digests of a shard in the order of their slots, with counts and parent slots inside their band."""
    def run(table: pa.Table) -> pa.Table:
        d1, d2 = _u64(table, "d1", "d2")
        conv = table.column("conv_id").to_numpy()
        order = np.lexsort((conv, d2, d1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(d1[order]) != 0) | (np.diff(d2[order]) != 0)
        heads = np.flatnonzero(new)
        first = order[heads]  # the smallest conversation of each digest
        table_hash = PerfectHash(d1[first], d2[first])
        slot = table_hash.slot
        flat = {"n_local": np.zeros(len(first), np.int64)}
        flat["n_local"][slot] = np.diff(np.append(heads, len(order)))
        for name in ("p1", "p2", "t1", "t2", "depth", "bytes"):
            flat[name] = np.zeros(len(first), np.int64)
            flat[name][slot] = table.column(name).to_numpy()[first]
        flat["min_conv"] = np.zeros(len(first), np.int64)
        flat["min_conv"][slot] = conv[first]
        p1, p2 = (flat[c].view(np.uint64) for c in ("p1", "p2"))
        parent = table_hash.find(p1, p2)
        parent[flat["depth"] % band == 0] = -1  # the root, and the first nodes of a band
        n = len(first)
        cols = {"shard": np.full(n, table.column("shard")[0].as_py()), "slot": np.arange(n), "parent_slot": parent,
                "d1": table_hash.d1.view(np.int64), "d2": table_hash.d2.view(np.int64), **flat}
        return pa.table({c.split()[0]: pa.array(cols[c.split()[0]], pa.int64()) for c in _NODE.split(", ")})
    return run


_SUM = ("d1 long, d2 long, n_leaves long, saved_tokens long, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long")


def _accumulate(table: pa.Table) -> pa.Table:
    """Subtree sums of the nodes that a shard owns, for all its nodes, through the parent slots."""
    carried = table.filter(pc.is_null(table.column("slot")))
    table = table.filter(pc.is_valid(table.column("slot"))).sort_by("slot")
    num = {c: table.column(c).to_numpy() for c in ("parent_slot", "depth", "bytes", "min_conv", "conv_id", "n_convs",
                                                   "n_children")}
    own = num["min_conv"] == num["conv_id"]
    leaves = np.where(own & (num["n_children"] == 0), 1, 0)
    saved = np.where(own, (num["n_convs"] - 1) * num["bytes"], 0)
    if carried.num_rows:
        table_hash = PerfectHash(*_u64(table, "d1", "d2"))
        at = np.argsort(table_hash.slot)[table_hash.find(*_u64(carried, "d1", "d2"))]
        np.add.at(leaves, at, carried.column("carried_leaves").to_numpy())
        np.add.at(saved, at, carried.column("carried_saved").to_numpy())
    parent, depth = num["parent_slot"], num["depth"]
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for some in np.split(order, cuts):  # deepest first
        some = some[parent[some] >= 0]
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    up = np.where(parent >= 0, num["conv_id"][parent], -1)
    mine = lambda x, also=True: pa.array(x, pa.int64(), mask=~(own & also))
    return pa.table({"d1": table.column("d1"), "d2": table.column("d2"), "n_leaves": pa.array(leaves, pa.int64()),
                     "saved_tokens": pa.array(saved, pa.int64()), "conv_id": mine(num["conv_id"]), "depth": mine(depth),
                     "parent_conv_id": mine(up, parent >= 0), "n_convs": mine(num["n_convs"]),
                     "n_children": mine(num["n_children"])})


def _end_pieces(batches):
    """Runs of one node's conversation ids, joined, in the order of the range partitions."""
    pid, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        d1, d2, conv = (np.asarray(batch.column(c)) for c in ("d1", "d2", "conv_id"))
        if not len(conv):
            continue
        cut = np.concatenate(([0], np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1, [len(conv)]))
        step = END_BYTES // 20
        spans = [(at, min(b, at + step)) for a, b in zip(cut[:-1], cut[1:], strict=True) for at in range(a, b, step)]
        yield pa.RecordBatch.from_pydict({
            "d1": d1[[a for a, _ in spans]], "d2": d2[[a for a, _ in spans]],
            "part": np.full(len(spans), pid, np.int32), "number": np.arange(number, number + len(spans)),
            "ids": [",".join(map(str, conv[a:b].tolist())) for a, b in spans]})
        number += len(spans)


def _end_digests(batches):
    """SHA-256 over each node's pieces, which follow one another; only the hash's state is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
            if (d1, d2) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (d1, d2), hashlib.sha256(ids.encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.string())], ["d1", "d2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of (d1, d2, conv_id): SHA-256 of the ids, ascending, joined by commas."""
    pieces = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id") \
        .mapInArrow(_end_pieces, "d1 long, d2 long, part int, number long, ids string")
    return put(pieces, "ends").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "part", "number") \
        .select("d1", "d2", "ids").mapInArrow(_end_digests, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, most: int = MOST, shard_rows: int = SHARD_ROWS,
                band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; equal turns by role, then by a digest of role and text.  Null roles
    and texts are empty.  Rows without a conv_id take no part; repeated rows are turns of their own; other columns
    are not read.  Every conversation with a row is a member of the root, also when none of its rebuilt turns is
    left; an empty table has no nodes.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt_turns(conversations, family, most)
    paths = put(prefixes(turns), "prefixes")
    release(spark)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in paths.columns if c != "conv_id"])
    every = paths.unionByName(root)
    size = every.count()
    shard = F.pmod(F.xxhash64("conv_id", F.floor(F.col("depth") / F.lit(band))), F.lit(1 + size // shard_rows))
    table = put(every.withColumn("shard", shard).groupBy("shard").applyInArrow(_node_table(band), _NODE),
                "node-table")

    same = ["depth", "p1", "p2", "t1", "t2", "bytes"]
    nodes = put(table.groupBy("d1", "d2").agg(
        F.min("min_conv").alias("conv_id"), F.sum("n_local").alias("n_convs"), *[F.min(c).alias(c) for c in same],
        F.max(F.struct(*same)).alias("high"), F.min(F.struct(*same)).alias("low")), "nodes")
    if nodes.filter("high <> low").take(1):
        raise RuntimeError("two prefixes share a digest")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")) \
        .agg(F.count("*").alias("n_children"))
    known = nodes.select("d1", "d2", "conv_id", "n_convs").join(children, ["d1", "d2"], "left") \
        .select("d1", "d2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"))
    local = put(table.select("shard", "slot", "parent_slot", "d1", "d2", "depth", "bytes", "min_conv")
                .join(known, ["d1", "d2"]), "local")

    whole = local
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is not None and deepest >= band:
        # what a conversation owns in deeper bands enters the last node of each of its bands
        of_band = F.floor(F.col("depth") / F.lit(band))
        owned = local.filter("min_conv = conv_id").groupBy("conv_id", of_band.alias("band")).agg(
            F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
            F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
        last = every.filter(F.col("depth") % band == band - 1).select("conv_id", of_band.alias("band"), "depth", "d1", "d2")
        deeper = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("conv_id", "band", "d1", "d2").join(owned, ["conv_id", "band"], "full") \
            .withColumn("carried_leaves", F.sum("leaves").over(deeper)).withColumn("carried_saved", F.sum("saved").over(deeper))
        carried = carried.filter("d1 IS NOT NULL AND carried_leaves IS NOT NULL").withColumn(
            "depth", F.col("band") * band).withColumn("shard", shard)
        whole = local.unionByName(carried.select("shard", "d1", "d2", "carried_leaves", "carried_saved"),
                                  allowMissingColumns=True)
    sums = whole.groupBy("shard").applyInArrow(_accumulate, _SUM).groupBy("d1", "d2").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")])
    if deepest is not None and deepest >= band:
        # the parents of a band's first nodes lie in other shards
        cross = nodes.filter((F.col("depth") % band == 0) & (F.col("depth") > 0)).select("d1", "d2", "p1", "p2")
        above = nodes.filter(F.col("depth") % band == band - 1).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"),
                                                                     F.col("conv_id").alias("above"))
        sums = sums.join(cross.join(above, ["p1", "p2"]).select("d1", "d2", "above"), ["d1", "d2"], "left") \
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))

    # the deepest prefix of a conversation is where it ends; turnless ones end at the root
    ends = paths.groupBy("conv_id").agg(F.max_by(F.struct("d1", "d2"), "depth").alias("e"))
    ends = put(convs.join(ends, "conv_id", "left").select(
        F.coalesce("e.d1", zero).alias("d1"), F.coalesce("e.d2", zero).alias("d2"), "conv_id"), "ends")
    out = sums.join(end_digests(ends), ["d1", "d2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
