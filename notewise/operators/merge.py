"""Merge and outcome intervals.

The original merge step is described but not scripted; here it is a chain of
joins: search ranks pivoted wide, clusters attached by text or id, visit keys
attached by row id, chunk intervals generated per visit, and adherence
counted by an equi-join on (participant, span of days) of each interval with
masks of dose days.  Interval expansion is bounded by the interval length, so
the range condition never becomes a nested-loop join, and the (participant,
span) key spreads a participant over many join keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The chunk table (label, first day, day after last) relative to
# the visit date.  The original study does not publish its chunk definition.
DEFAULT_CHUNKS = [("before", -7, 0), ("after1", 0, 7), ("after2", 7, 14)]

#: Days whose doses are packed into one mask: few, as a span of a participant is a key.
SPAN = 8


def ranks_to_wide(results: DataFrame, id_col: str = "query_index", k: int = 5,
                  text_col: str = "matched_sentence", score_col: str = "similarity_score") -> DataFrame:
    """F1: long (id, rank, text, score) -> top{r}_matched_sentence / top{r}_similarity_score.

    One conditional aggregation (what ``pivot`` compiles to) with partial
    aggregation on the map side.
    """
    aggs = []
    for r in range(1, k + 1):
        aggs.append(F.max(F.when(F.col("rank") == r, F.col(text_col))).alias(f"top{r}_{text_col}"))
        aggs.append(F.max(F.when(F.col("rank") == r, F.col(score_col))).alias(f"top{r}_{score_col}"))
    return results.groupBy(id_col).agg(*aggs)


def attach_cluster(df: DataFrame, clusters: DataFrame, on: str = "query_text",
                   cluster_col: str = "cluster") -> DataFrame:
    """many-to-one equi-join of rows to their cluster (by text or id)."""
    return df.join(clusters.select(on, cluster_col), on, "left")


def attach_visit(df: DataFrame, visits: DataFrame, on: str = "row_id") -> DataFrame:
    """attach visit keys (participant, visit code, visit date) by row id."""
    return visits.join(df, on, "inner")


def visit_intervals(visits: DataFrame, chunks: Sequence[tuple[str, int, int]] = DEFAULT_CHUNKS,
                    date_col: str = "visit_date") -> DataFrame:
    """one row per (visit, chunk) with start_date and inclusive end_date.

    The chunk table is a parameter literal expanded in-row (no join).
    """
    lit = F.array(*[F.struct(F.lit(c).alias("chunk"), F.lit(a).alias("d0"), F.lit(b).alias("d1"))
                    for c, a, b in chunks])
    out = visits.select("*", F.explode(lit).alias("_c"))
    return out.select(*visits.columns, F.col("_c.chunk").alias("chunk"),
                      F.date_add(F.col(date_col), F.col("_c.d0")).alias("start_date"),
                      F.date_add(F.col(date_col), F.col("_c.d1") - 1).alias("end_date"))


def dose_days(events: DataFrame, participant_col: str, ts_col: str) -> DataFrame:
    """Distinct (participant, day) pairs of dosing events."""
    return events.select(F.col(participant_col).alias("participant_id"),
                         F.to_date(ts_col).alias("day")).distinct()


def interval_adherence(intervals: DataFrame, doses: DataFrame, key_cols: Sequence[str] = ("row_id", "chunk"),
                       participant_col: str = "participant_id") -> DataFrame:
    """share of interval days with a dose = distinct dose days / interval days.

    Dose days are packed to a mask a participant and span of ``SPAN`` days.
    Each interval meets the masks of the spans that it touches, not of each
    day, on (participant, span), and counts its own days in them; intervals
    without doses keep a zero.
    """
    day = F.unix_date("day")
    span = F.floor(day / SPAN)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (day - span * SPAN).cast("int"))
    masks = doses.withColumnRenamed("participant_id", participant_col).groupBy(participant_col, span.alias("_span")) \
        .agg(F.bit_or(bit).alias("_mask"))
    # least() passes over nulls
    whole = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    first, last = (F.when(whole, F.unix_date(c)) for c in ("start_date", "end_date"))
    touched = intervals.select(*key_cols, participant_col, F.least(first, last).alias("_a"), F.greatest(first, last).alias("_e")).withColumn(
        "_span", F.explode(F.sequence(F.floor(F.col("_a") / SPAN), F.floor(F.col("_e") / SPAN))))
    # days of the span before the interval, and up to its end
    low = F.greatest(F.col("_a") - F.col("_span") * SPAN, F.lit(0)).cast("int")
    high = F.least(F.col("_e") - F.col("_span") * SPAN + 1, F.lit(SPAN)).cast("int")
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    days = F.bit_count(F.col("_mask").bitwiseAND(ones(high) - ones(low)))
    cnt = touched.join(masks, [participant_col, "_span"]).groupBy(*key_cols).agg(F.sum(days).alias("dose_days"))
    n_days = F.datediff("end_date", "start_date") + 1
    return intervals.join(cnt, list(key_cols), "left").withColumn(
        "dose_days", F.coalesce("dose_days", F.lit(0)).cast("bigint")).withColumn(
        "adherence", F.col("dose_days") / n_days.cast("double"))
