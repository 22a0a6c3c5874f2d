"""Grouped cross-validation and metrics.

Folds are a column: one frame carries every split, training sets are
``fold <> f`` and test sets ``fold = f``.  Where a model only needs sums,
statistics are computed per fold once and a training set is total - fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.functions.stats import t_ppf


# ---------------------------------------------------------------------------
# H1: group k-fold.  Groups are taken by size descending (ties: group id
# descending) and each goes to the currently lightest fold (ties: lowest
# fold).  The greedy only depends on sizes, so it is run on the histogram of
# group sizes: runs of equal-size groups reduce to a fill phase (one fold
# takes consecutive groups) and then a periodic phase (a fixed fold order
# repeats).  The driver sees one row per distinct size; groups get their fold
# by a join on size plus their ordinal within that size.
# ---------------------------------------------------------------------------

def fold_segments(hist: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first ordinal, end ordinal, fold order) covering every group."""
    loads = [0] * n_splits
    segs = []
    for size, cnt in sorted(hist, key=lambda t: -t[0]):
        pos = 0
        while pos < cnt:
            order = sorted(range(n_splits), key=lambda f: (loads[f], f))
            f0, fl = order[0], order[-1]
            if n_splits == 1 or loads[f0] + size > loads[fl] or (loads[f0] + size == loads[fl] and f0 > fl):
                rem = cnt - pos
                segs.append((size, pos, cnt, order))
                full, extra = divmod(rem, n_splits)
                for i, f in enumerate(order):
                    loads[f] += size * (full + (1 if i < extra else 0))
                pos = cnt
            else:
                f1 = order[1]
                t = loads[f1] - loads[f0]
                m = (-(-t // size)) + (1 if t % size == 0 and f0 < f1 else 0)
                m = max(1, min(m, cnt - pos))
                segs.append((size, pos, pos + m, [f0]))
                loads[f0] += m * size
                pos += m
    return segs


def group_kfold(df: DataFrame, group_col: str, n_splits: int = 5, fold_col: str = "fold") -> DataFrame:
    """(group, fold 1..n_splits) -- whole groups per fold, greedy size balance."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    hist = [(int(r["_n"]), int(r["count"])) for r in sizes.groupBy("_n").count().collect()]
    if sum(c for _, c in hist) < n_splits:
        raise ValueError(f"cannot have {n_splits} folds with {sum(c for _, c in hist)} groups")
    segs = fold_segments(hist, n_splits)
    seg_df = df.sparkSession.createDataFrame(
        [(s, a, b, o) for s, a, b, o in segs], "_n long, _a long, _b long, _order array<int>")
    # ordinal among groups of equal size, by group id descending; ranked
    # without a per-size window so one very common size is still spread out
    from notewise.operators.clustering import rank_within

    ranked = rank_within(sizes, "_n", [F.desc(group_col)], out="_ord")
    j = ranked.join(F.broadcast(seg_df), "_n").filter((F.col("_ord") >= F.col("_a")) & (F.col("_ord") < F.col("_b")))
    fold = F.element_at("_order", (F.pmod(F.col("_ord") - F.col("_a"), F.size("_order")) + 1).cast("int")) + 1
    return j.select(group_col, fold.cast("bigint").alias(fold_col))


def with_folds(df: DataFrame, group_col: str, n_splits: int = 5, fold_col: str = "fold",
               by: str | None = None) -> DataFrame:
    """Attach the fold of each row's group; with ``by`` every value of it is split on its own rows."""
    if by is None:
        return df.join(group_kfold(df, group_col, n_splits, fold_col), group_col)
    out = None
    for (v,) in sorted(tuple(r) for r in df.select(by).distinct().collect()):
        part = with_folds(df.filter(F.col(by) == F.lit(v)), group_col, n_splits, fold_col)
        out = part if out is None else out.unionByName(part)
    return out


def split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """H2: (train, test) of one fold as filters on the same frame."""
    return df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)


def fold_counts(df: DataFrame, group_col: str, fold_col: str = "fold", by: str | None = None) -> DataFrame:
    """H3: distinct groups and rows in the training and test part of every fold (of every value of ``by``).

    Test counts are per fold; training counts are totals minus the fold
    (groups never straddle folds).
    """
    keys = [by] if by else []
    per = df.groupBy(*keys, fold_col).agg(F.countDistinct(group_col).alias("n_test_participants"),
                                          F.count(F.lit(1)).alias("n_test_samples"))
    w = Window.partitionBy(*keys)  # one row per fold
    return per.select(
        *keys, fold_col,
        (F.sum("n_test_participants").over(w) - F.col("n_test_participants")).cast("bigint").alias("n_train_participants"),
        F.col("n_test_participants").cast("bigint").alias("n_test_participants"),
        (F.sum("n_test_samples").over(w) - F.col("n_test_samples")).cast("bigint").alias("n_train_samples"),
        F.col("n_test_samples").cast("bigint").alias("n_test_samples"))


def clip01(c) -> Column:
    """H4: clip predictions to [0, 1]."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def regression_metrics(preds: DataFrame, y: str = "y", p: str = "pred", by: str | list = "fold") -> DataFrame:
    """H5-H7: MAE, RMSE and R^2 (1 - SSE/SST, SST around the group mean), in one aggregation.

    SST is n times the population variance, which Spark merges from centred
    moments.  R^2 follows the convention of a constant truth: 1 when SSE is 0,
    else 0.
    """
    by = [by] if isinstance(by, str) else list(by)
    err = F.col(y) - F.col(p)
    agg = preds.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"))
    r2 = F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)) \
        .otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst"))
    return agg.select(*by, "mae", "rmse", r2.alias("r2"))


def summarise_folds(metrics: DataFrame, cols=("mae", "rmse", "r2"), by: list | None = None,
                    spread: str = "pop") -> DataFrame:
    """H8: mean and std over folds (population std by default, as NumPy)."""
    std = F.stddev_pop if spread == "pop" else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c.upper()}_mean"), std(c).alias(f"{c.upper()}_std")]
    return metrics.groupBy(*(by or [])).agg(*aggs)


def fold_ci(metrics: DataFrame, cols=("mae", "rmse", "r2"), level: float = 0.95) -> DataFrame:
    """H9: t-based CI over folds (sample std, df = folds - 1), one row per metric."""
    n = metrics.count()
    t = t_ppf(0.5 + level / 2.0, n - 1) if n > 1 else float("nan")
    rows = None
    for c in cols:
        r = metrics.agg(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
        r = r.select("metric", "mean", "std",
                     (F.col("std") / F.lit(math.sqrt(n))).alias("se"),
                     (F.col("mean") - F.lit(t) * F.col("std") / F.lit(math.sqrt(n))).alias("ci_lower"),
                     (F.col("mean") + F.lit(t) * F.col("std") / F.lit(math.sqrt(n))).alias("ci_upper"))
        rows = r if rows is None else rows.unionByName(r)
    return rows
