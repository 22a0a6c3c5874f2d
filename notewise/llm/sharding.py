"""Sharding by minimax contiguous partition.

Rows are put into atomic groups: texts whose MD5 begins with the same
``GROUP_BITS`` bits, so equal texts always share a group and a shard.  Group
sizes, in the order of that prefix, are summed by Spark; there are at most
``2 ** GROUP_BITS`` of them at any input size, and only they reach the driver.
There a binary search finds the smallest capacity for which a greedy pass over
the ordered sizes needs no more than the wanted shards, and the cuts of that
pass are the shard bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import put, rank_in_key

SHARDS = 16
#: Atomic groups: the first bits of the text's MD5. 16 bits give 4,096 groups for each of 16 shards.
GROUP_BITS = 16


def greedy_cuts(sizes: np.ndarray, capacity: int) -> list[int]:
    """First group of every part when each part takes groups as long as they fit."""
    ends = np.cumsum(sizes)
    cuts, at = [], 0
    while at < len(sizes):
        cuts.append(at)
        full = capacity + (ends[at - 1] if at else 0)
        at = max(at + 1, int(np.searchsorted(ends, full, side="right")))
    return cuts


def minimax_cuts(sizes, parts: int) -> tuple[int, list[int]]:
    """Smallest capacity that lets the ordered ``sizes`` fill at most ``parts`` parts, and the cuts.

    The greedy cuts at that capacity may leave parts empty at the end; then the
    largest parts with several groups are split, which raises no part.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, []
    low, high = int(sizes.max()), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) <= parts:
            high = middle
        else:
            low = middle + 1
    cuts = greedy_cuts(sizes, low)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    while len(cuts) < min(parts, len(sizes)):
        bounds = [*cuts, len(sizes)]
        spans = [(int(ends[b] - ends[a]), -a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
        total, a, b = max(spans)
        a = -a
        half = int(np.searchsorted(ends, ends[a] + total / 2, side="left"))
        cuts = sorted([*cuts, min(max(half, a + 1), b - 1)])
    return low, cuts


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    group_bits: int = GROUP_BITS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1; ``text_crc32``
    is that of the text, 0 for null or empty.  The law is ``bytes``: the largest
    shard is as small as contiguous parts of the ordered groups allow.  ``slot``
    counts from 0 without gaps inside a shard, in the order of group, MD5 and id.
    Rows that repeat id and text get neighbouring slots.  No rows in, no rows out.
    """
    if not 1 <= group_bits <= 20:
        raise ValueError("group_bits must lie between 1 and 20: the group sizes go to the driver")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = put(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("md5_")),
        "sizes").withColumn("group_", F.shiftright(F.conv(F.substring("md5_", 1, 5), 16, 10).cast("int"),
                                                    20 - group_bits))
    sizes = rows.groupBy("group_").agg(F.sum("size").alias("bytes")).orderBy("group_").collect()
    _, cuts = minimax_cuts([r["bytes"] for r in sizes], shards)
    bounds = [sizes[c]["group_"] for c in cuts]
    shard = F.lit(-1)
    for bound in bounds:
        shard = shard + (F.col("group_") >= bound).cast("int")
    placed = rank_in_key(rows.withColumn("shard", shard.cast("int")), "shard", ["md5_", "doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "group_")
