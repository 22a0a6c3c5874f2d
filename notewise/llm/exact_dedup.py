"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  The distinct blocks
are sorted (by a hash, then by content) and named by integers in that order; then adjacent names are paired,
the distinct pairs are sorted and named again, and so on until each document has
one name.  A name stands for one byte sequence only: no hash decides equality.

Block contents move once: each task names the blocks that it meets locally, so a
block that a third of all rows hold is sorted once per task, and only the small
local and global names are joined back to documents.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import drop, fresh, put, release

BLOCK_BYTES = 4096
#: Bytes of distinct blocks that a task holds before it starts a new window of local names.
WINDOW_BYTES = 24 << 20

_LOCAL = "block binary, win long, local long, row long, doc_id long, sha string, refs array<long>"
_LOCAL_ARROW = pa.schema([("block", pa.binary()), ("win", pa.int64()), ("local", pa.int64()), ("row", pa.int64()),
                          ("doc_id", pa.int64()), ("sha", pa.string()), ("refs", pa.list_(pa.int64()))])


def _name_locally(block_bytes: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 40
        win, seen, held, row = 0, {}, 0, 0
        for batch in batches:
            out = {name: [] for name in _LOCAL_ARROW.names}
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if held > WINDOW_BYTES:
                    win, seen, held = win + 1, {}, 0
                refs = []
                for at in range(0, max(1, len(raw)), block_bytes):
                    block = raw[at:at + block_bytes]
                    local = seen.get(block)
                    if local is None:
                        local = seen[block] = len(seen)
                        held += len(block) + 100
                        size += len(block)
                        for name, value in zip(_LOCAL_ARROW.names, (block, base + win, local, None, None, None, None),
                                               strict=True):
                            out[name].append(value)
                    refs.append(local)
                for name, value in zip(_LOCAL_ARROW.names,
                                       (None, base + win, None, base + row, doc_id,
                                        hashlib.sha256(raw).hexdigest(), refs), strict=True):
                    out[name].append(value)
                row += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=_LOCAL_ARROW)
                    out, size = {name: [] for name in _LOCAL_ARROW.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=_LOCAL_ARROW)
    return run


def _number_runs(batches):
    """Names for sorted rows (key, win, local): equal keys get one name, in the order of the keys."""
    base, last, n = TaskContext.get().partitionId() << 40, None, -1
    for batch in batches:
        names = []
        for key in batch.column(0):
            key = key.as_py()
            if n < 0 or key != last:
                last, n = key, n + 1
            names.append(base + n)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(names, pa.int64())],
                                         names=["win", "local", "name"])


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (row, doc_id, sha, level, name) per input row.

    Two rows have the same (level, name) exactly when their texts are identical
    (null counts as empty).  ``row`` is unique.
    """
    spark = docs.sparkSession
    local = put(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                .mapInArrow(_name_locally(block_bytes), _LOCAL), "blocks")
    rows = put(local.filter("row IS NOT NULL").select("row", "win", "doc_id", "sha", "refs"), "rows")
    blocks = local.filter("local IS NOT NULL").select("block", "win", "local")
    # sorted by hash, then content: range bounds are sampled as 8 bytes, and a common beginning is no hot range
    named = put(blocks.withColumn("hash", F.xxhash64("block")).repartitionByRange("hash")
                .sortWithinPartitions("hash", "block").select("block", "win", "local")
                .mapInArrow(_number_runs, "win long, local long, name long"), "names")
    drop(local)
    release(spark)

    refs = rows.select("row", "win", F.posexplode("refs").alias("pos", "local"))
    level = put(refs.join(named, ["win", "local"]).select("row", F.col("pos").cast("long").alias("pos"), "name"),
                "level")
    width, done, k = F.size("refs"), None, 0
    most = rows.agg(F.max(width)).first()[0] or 0
    ends = level.join(rows.filter(width == 1).select("row"), "row", "left_semi") \
        .select("row", F.lit(0).alias("level"), "name")
    done = ends
    multi = level.join(rows.filter(width > 1).select("row"), "row", "left_semi")
    while most > 1:
        k += 1
        most = (most + 1) // 2
        # name adjacent pairs; an odd last block pairs with nothing (-1)
        pairs = multi.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right_"))
        pairs = put(pairs, "pairs")
        names = put(pairs.select("left_", "right_").distinct().repartitionByRange("left_", "right_")
                    .sortWithinPartitions("left_", "right_")
                    .withColumn("name", F.monotonically_increasing_id()), "pairnames")
        level = put(pairs.join(names, ["left_", "right_"]).select("row", "pos", "name"), "level")
        drop(pairs, names)
        sizes = level.groupBy("row").agg(F.count("*").alias("n"), F.max("name").alias("name"))
        done = done.unionByName(sizes.filter("n = 1").select("row", F.lit(k).alias("level"), "name"))
        multi = level.join(sizes.filter("n > 1").select("row"), "row", "left_semi")
    return rows.select("row", "doc_id", "sha").join(done, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays.  A null text counts
    as empty; a null id is smaller than all others; of rows that repeat both id
    and text exactly one is ``kept``.  No rows in, no rows out.
    """
    named = put(identities(docs, id_col, text_col, block_bytes), "identities")
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("last"),
                                                F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is found again by its id and the SHA-256 of its text, so rows that
    repeat both count as one, whose other columns are those of any one of them.
    Columns of any name pass through.
    """
    kept_id, kept_sha, own = fresh("kept_id"), fresh("kept_sha"), fresh("sha")
    kept = exact_dedup(docs, id_col, text_col).filter("kept") \
        .select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    kept = put(kept, "kept")
    release(docs.sparkSession)
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    met = docs.withColumn(own, sha).join(
        kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_sha)), "left_semi")
    # after the join, rows of one (id, text) lie together: no further exchange
    return met.dropDuplicates([id_col, own]).select(*docs.columns)
