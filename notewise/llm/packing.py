"""Packing into optimal length buckets.

The global histogram of token counts (one row per distinct count) goes to the
driver, where dynamic programming picks the bucket bounds that minimise the
padding of all documents.  Inside a bucket, documents form batches whose padded
size stays within a token budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import put, rank_in_key

BUCKETS = 8
#: Padded tokens of a batch.
TOKEN_BUDGET = 65_536
_WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text_col: str):
    """Words of a text as its token count; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """Least total padding with at most ``buckets`` buckets, and the bucket bounds.

    ``histogram``: (length, documents) by rising length.  A bucket pads its
    documents to its largest length.  best[j] over the first j lengths is
    min_i prev[i] + length_j * (N_j - N_i) - (T_j - T_i): for rising length_j the
    lines (-N_i, prev[i] + T_i) have falling slopes, so a lower hull answers all j
    in linear time.  Of equally good first cuts the smallest i is taken.
    """
    if not histogram:
        return 0, []
    lengths = [x[0] for x in histogram]
    docs, total = [0], [0]
    for length, count in histogram:
        docs.append(docs[-1] + count)
        total.append(total[-1] + length * count)
    n = len(lengths)
    best = [0] + [lengths[j - 1] * docs[j] - total[j] for j in range(1, n + 1)]
    cuts = [[0] * (n + 1)]
    for _ in range(min(buckets, n) - 1):
        hull, at = [], 0
        new, cut = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            m, b = -docs[i], best[i] + total[i]
            while len(hull) >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                # the last line is nowhere strictly lowest
                if (b - b1) * (m1 - m2) < (b2 - b1) * (m1 - m):
                    hull.pop()
                else:
                    break
            hull.append((m, b, i))
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            m, b, i = hull[at]
            new[j], cut[j] = m * x + b + x * docs[j] - total[j], i
        best = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j <= 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    return best[n], bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id",
         text_col: str = "text", order: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

    Buckets are numbered from 0 by rising length.  A batch holds
    ``max(1, token_budget // bucket_len)`` documents of one bucket in the order
    of doc_id, or of ``order``: its columns that ``docs`` has too name a document,
    the others rank it.  A document longer than the budget is a batch of its own.  Texts
    without words have 0 tokens and take part like others.  The driver receives
    one pair per distinct token count, which the longest text bounds.
    """
    names = [c for c in order.columns if c in docs.columns] if order is not None else []
    rows = put(docs.select(F.col(id_col).cast("long").alias("doc_id"), n_tokens(text_col).alias("n_tokens"),
                           *[F.col(c).alias(f"_of_{c}") for c in names]), "lengths")
    by = ["doc_id"]
    if order is not None:
        ranks = [c for c in order.columns if c not in names]
        same = F.lit(True)
        for c in names:
            same &= rows[f"_of_{c}"].eqNullSafe(order[c])
        rows, by = rows.join(order, same, "left").select(rows["doc_id"], "n_tokens", *ranks), [*ranks, "doc_id"]
    histogram = [(r["n_tokens"], r["n"]) for r in
                 rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()]
    _, bounds = optimal_bounds(histogram, buckets)
    bucket, width = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        bucket = F.when(F.col("n_tokens") > low, F.lit(k + 1)).otherwise(bucket)
        width = F.when(F.col("n_tokens") > low, F.lit(high).cast("long")).otherwise(width)
    ranked = rank_in_key(rows.withColumn("bucket", bucket).withColumn("bucket_len", width), "bucket", by)
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len",
                         F.expr("rank_").alias("rank_"), per.alias("per_")) \
        .select("doc_id", "n_tokens", "bucket", "bucket_len", F.expr("rank_ div per_").alias("batch"),
                (F.col("rank_") % F.col("per_")).alias("slot"),
                (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
