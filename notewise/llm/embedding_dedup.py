"""Near-duplicate embeddings by p-stable (Euclidean) hashing.

Vectors are brought to length one.  In each of ``TABLES`` tables, ``PROJECTIONS``
Gaussian projections, shifted and cut into cells of ``WIDTH``, name a bucket; only
vectors of one label that share a bucket are compared, by their exact cosine in
double precision.  At the threshold 0.98 (distance 0.2) a pair shares a bucket of one
table with probability 0.87 ** 7 = 0.37 and misses all 18 tables with 3e-4; closer
pairs miss far less often.  A pair that meets in several tables counts in the first.

Equal vectors are one vector with a count.  Pairs are never emitted: a bucket gives
counts of links and a spanning forest of its linked vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import components, put, release
from notewise.llm.tokens import mix

THRESHOLD = 0.98
TABLES = 18
PROJECTIONS = 7
WIDTH = 1.2
#: Vectors of a bucket that one task compares with one another; larger buckets are split into pairs of blocks.
BLOCK = 2_048
#: Bytes of hashed vectors that a group of buckets holds on average.
GROUP_BYTES = 16 << 20
SEED = 8


def _hashes(unit: np.ndarray, seed_label: np.ndarray) -> np.ndarray:
    """Bucket names (rows, TABLES) of unit vectors; the label is part of the name."""
    rng = np.random.Generator(np.random.PCG64([SEED, unit.shape[1]]))
    directions = rng.standard_normal((unit.shape[1], TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(unit), TABLES, PROJECTIONS)
    out = mix(seed_label.astype(np.uint64))[:, None] + np.arange(TABLES, dtype=np.uint64)[None, :]
    for j in range(PROJECTIONS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return out.astype(np.int64)


def _emit(batches):
    """(rep, label, dim, weight, vector bytes, names) of usable vectors, in one row each."""
    for batch in batches:
        rep, label, dim, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        vectors = batch.column(4)
        keep, blobs, names = [], [], []
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            x = np.array([vectors[int(i)].as_py() for i in at], float).reshape(len(at), d)
            # by the largest component first, so that squares neither overflow nor vanish
            x = x / np.abs(x).max(1)[:, None]
            unit = x / np.sqrt((x * x).sum(1))[:, None]
            keys = _hashes(unit, label[at])
            keep.extend(at)
            blobs.extend(row.tobytes() for row in unit)
            names.extend(row.tobytes() for row in keys)
        keep = np.array(keep, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[keep], pa.int64()), pa.array(label[keep], pa.int64()), pa.array(dim[keep], pa.int32()),
             pa.array(count[keep], pa.int64()), pa.array(blobs, pa.binary()), pa.array(names, pa.binary())],
            names=["rep", "lab", "dim", "weight", "unit", "names"])


def _buckets(batches):
    """(rep, table, bucket) for every vector and table."""
    for batch in batches:
        rep = batch.column(0).to_numpy()
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(rep, TABLES)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(rep))),
             pa.array(keys)], names=["rep", "table", "bucket"])


def _compare(threshold: float):
    def bucket(out, table, rep, lab, dim, weight, unit, keys, side):
        n = len(rep)
        x = np.frombuffer(b"".join(unit), float).reshape(n, -1)
        links = np.zeros(n, np.int64)
        near = np.zeros((n, n), bool)
        for at in range(0, n, 512):
            near[at:at + 512] = x[at:at + 512] @ x.T >= threshold
        np.fill_diagonal(near, False)
        near &= lab[:, None] == lab[None, :]
        if side is not None:  # two blocks: pairs across only
            near &= side[:, None] != side[None, :]
        if not near.any():
            return
        for t in range(table):  # pairs that met in an earlier table are counted there
            near &= keys[:, t][:, None] != keys[:, t][None, :]
        links = near @ weight
        root = np.full(n, -1)
        for start in np.flatnonzero(near.any(1))[np.argsort(rep[near.any(1)], kind="stable")]:
            if root[start] >= 0:
                continue
            edge = np.zeros(n, bool)
            edge[start] = True
            root[start] = start
            while edge.any():
                edge = near[edge].any(0) & (root < 0)
                root[edge] = start
        some = np.flatnonzero(root >= 0)
        out.append((rep[some], links[some], rep[root[some]]))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("table", "ascending"), ("low", "ascending"),
                               ("high", "ascending"), ("rep", "ascending")])
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        num = {c: col[c].to_numpy(zero_copy_only=False) for c in
               ("bucket", "table", "low", "high", "rep", "lab", "dim", "weight", "block")}
        new = np.ones(table.num_rows, bool)
        if table.num_rows:
            new[1:] = (np.diff(num["bucket"]) != 0) | (np.diff(num["table"]) != 0) | (np.diff(num["low"]) != 0) \
                | (np.diff(num["high"]) != 0)
        starts = np.append(np.flatnonzero(new), table.num_rows)
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a < 2:
                continue
            keys = np.frombuffer(b"".join(col["names"][a:b].to_pylist()), np.int64).reshape(b - a, TABLES)
            for d in np.unique(num["dim"][a:b]):
                at = a + np.flatnonzero(num["dim"][a:b] == d)
                side = num["block"][at] if num["low"][a] != num["high"][a] else None
                bucket(out, int(num["table"][a]), num["rep"][at], num["lab"][at], d, num["weight"][at],
                       [col["unit"][int(i)].as_py() for i in at], keys[at - a], side)
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"rep": pa.array(parts[0], pa.int64()), "links": pa.array(parts[1], pa.int64()),
                         "root": pa.array(parts[2], pa.int64())})
    return run


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared inside equal labels and equal lengths; those that are
    null, zero, or hold null or non-finite components, and rows with a null label
    or id, link with nothing (n_links 0, component the own id, kept).  ``n_links``
    counts the other rows linked directly, equal vectors included.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) \
        & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) \
        & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label"))
    # + 0.0 turns -0.0 into 0.0, so equal vectors have equal keys
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))) \
        .withColumn("v", F.when(F.col("usable"), F.transform(v, lambda x: x + F.lit(0.0)))) \
        .withColumn("lab", F.xxhash64(F.col("label").cast("string"))) \
        .withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    same = ["lab", "k1", "k2"]
    reps = put(rows.filter("usable").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"),
                                                      F.first("v").alias("v")), "reps")
    hashed = put(reps.select("rep", "lab", F.size("v").alias("dim"), "weight", "v")
                 .mapInArrow(_emit, "rep long, lab long, dim int, weight long, unit binary, names binary"), "hashed")
    buckets = put(hashed.select("rep", "names").mapInArrow(_buckets, "rep long, table int, bucket long"), "buckets")
    full = buckets.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = buckets.join(full, ["table", "bucket"]).withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("rep", "table", "bucket", "block", F.least("block", "other").alias("low"),
                F.greatest("block", "other").alias("high"))
    # a member of a bucket of several blocks is sent once for each of them
    sent = full.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    width = hashed.agg(F.max("dim")).first()[0] or 0
    groups = 1 + int(sent) * (8 * width + 8 * TABLES + 64) // GROUP_BYTES
    found = met.join(hashed, "rep").withColumn("group", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups))) \
        .groupBy("group").applyInArrow(_compare(threshold), "rep long, links long, root long")
    found = put(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    release(spark)
    known = reps.select(*same, "rep", "weight").join(links, "rep", "left") \
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = put(known.select(*same, "weight", "rep", F.coalesce("links", F.lit(0)).alias("links"),
                             F.coalesce("component", "rep").alias("component")), "known")
    out = rows.select("vec_id", "usable", *same).filter("usable").join(known, same).select(
        "vec_id", (F.col("weight") - 1 + F.col("links")).cast("long").alias("n_links"),
        F.col("component").alias("component_id"))
    out = out.unionByName(rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                           F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
