"""Clustering and cluster quality.

Rows are (id, vec array<double>[, cluster]).  Everything that grows with the
data -- assignment, centre sums, distances, silhouette sums -- runs on the
executors; only k x d centres and k-row summaries reach the driver, the same
split MLlib's own K-means uses.

Exact Euclidean silhouette is inherently O(n^2).  It is a join of blocks of
points (:mod:`notewise.operators.pairwise`): a task reduces the distances of
its pairs of blocks to k per-cluster sums per point, and the sums of a
point are added up by a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.functions.vectors import as_doubles
from notewise.operators.pairwise import (distance_sums, map_block_pairs, nearest, nearest_of_runs, row_slices,
                                         squared_distances, summed_pairs)

#: Rounds after which K-means stops though it still moves (the usual default).
MAX_ROUNDS = 300
#: Bytes of a matrix of packed vectors.
PACK_BYTES = 4 << 20
#: A round works on slices of this share of the usual bytes, which stay in the processor's cache.
ROUND_SHARE = 8
#: Bytes of the partial sums that the driver adds up at a time.
PARTIAL_BYTES = 64 << 20


def _matrix(series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def _lists(m: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _dims(df: DataFrame, vec: str) -> int:
    return int(df.select(F.max(F.size(vec))).first()[0] or 0)


# ---------------------------------------------------------------------------
# Assignment and Lloyd iterations
# ---------------------------------------------------------------------------

def assign(df: DataFrame, id_col: str, vec: str, centres: np.ndarray,
           out: str = "cluster") -> DataFrame:
    """Nearest centre by squared Euclidean distance; ties -> lowest cluster id.

    Returns (id, out, dist2).  Centres (k x d, small) travel as a broadcast.
    """
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    id_type = df.schema[id_col].dataType

    def kernel(batches):
        c = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            lab, d2 = nearest(_matrix(pdf[vec]), c)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out: lab.astype(np.int64), "dist2": d2})

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(out, T.LongType()),
                           T.StructField("dist2", T.DoubleType())])
    return df.select(id_col, vec).mapInPandas(kernel, schema)


def centres_of(df: DataFrame, vec: str, cluster: str, d: int) -> DataFrame:
    """Per-cluster mean vector and size: one partial aggregation, d sums."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(F.col(vec)[i]) for i in range(d)]).alias("centre"))


def lloyd(df: DataFrame, id_col: str, vec: str, init_centres, iterations: int = MAX_ROUNDS, tol: float = 1e-12):
    """Deterministic Lloyd from given centres, until no centre moves by more than ``tol``.

    Each round is one job: assignment and per-cluster sums on the executors,
    k x d sums to the driver.  An empty cluster keeps its previous centre.
    Returns (assignments DataFrame(id, cluster, dist2), centres ndarray k x d).
    """
    data = df.select(id_col, vec).persist()
    centres = lloyd_many(data, vec, {0: init_centres}, iterations, tol)[0]
    return assign(data, id_col, vec, centres), centres


def first_k_centres(df: DataFrame, id_col: str, vec: str, k: int) -> np.ndarray:
    """Initial centres = the k rows with the smallest ids (a top-k, k small)."""
    rows = df.select(id_col, vec).orderBy(id_col).limit(k).collect()
    return np.vstack([np.asarray(r[vec], dtype=np.float64) for r in rows])


def first_k_many(df: DataFrame, id_col: str, vec: str, ks) -> dict:
    """:func:`first_k_centres` for several k by one top-k."""
    rows = first_k_centres(df, id_col, vec, max(ks))
    return {k: rows[:k] for k in ks}


def vectors_for_ml(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    """array<double> -> ML dense vector (elements made non-null first)."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))))


def _uniform(h: np.ndarray, *key: int) -> np.ndarray:
    """Numbers in [0, 1) of row hashes for a key: the same wherever and however often a row is read."""
    x = h.astype(np.uint64)
    for k in (*key, 1):
        x = x + np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


def _per_run(data: DataFrame, vec: str, sets: dict, found, schema: str) -> DataFrame:
    """Rows of ``found(run, x, h, nearest candidate, squared distance)`` for every run, all in one pass.

    ``sets`` holds the candidates of each run (a few k rows); they travel as one broadcast.
    """
    bc = data.sparkSession.sparkContext.broadcast({run: np.asarray(c, dtype=np.float64) for run, c in sets.items()})

    def kernel(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x, h = _matrix(pdf[vec]), pdf["h"].to_numpy()
            for run, c in bc.value.items():
                best, d2 = (np.zeros(len(x), np.int64), np.zeros(len(x))) if not len(c) else nearest(x, c)
                out = found(run, x, h, best, d2)
                if out is not None and len(out):
                    yield out

    return data.mapInPandas(kernel, schema)


def seed_many(data: DataFrame, vec: str, runs: dict, seed: int = 42, steps: int = 2) -> dict:
    """k-means|| (Bahmani et al. 2012) for many runs in the same passes: {run: k} -> {run: initial centres}.

    ``data`` has (vec, h), h a hash of the id.  Every run starts from one row; in each of ``steps`` rounds a pass
    sums the squared distances to its candidates and a pass samples about 2k more in proportion to them.
    The candidates, weighted by the rows nearest to them, are reduced to k by weighted k-means++ on the driver, which
    sees about (2 steps + 1) k rows a run, whatever the number of rows.
    """
    keys = list(runs)
    d = None

    def lowest(run, x, h, best, d2):
        u = _uniform(h, seed, run)
        i = int(np.argmin(u))
        return pd.DataFrame({"run": [run], "u": [u[i]], "v": [x[i]]})

    first = _per_run(data, vec, {i: np.zeros((0, 0)) for i in range(len(keys))}, lowest, "run int, u double, v array<double>")
    found = {int(r["run"]): np.asarray(r["v"])[None, :] for r in
             first.groupBy("run").agg(F.min_by("v", "u").alias("v")).collect()}
    for step in range(steps):
        cost = {int(r["run"]): r["c"] for r in _per_run(
            data, vec, found, lambda run, x, h, best, d2: pd.DataFrame({"run": [run], "c": [float(d2.sum())]}),
            "run int, c double").groupBy("run").agg(F.sum("c").alias("c")).collect()}
        scale = {run: 2.0 * runs[keys[run]] / c for run, c in cost.items() if c > 0}
        if not scale:
            break

        def sample(run, x, h, best, d2, scale=scale, step=step):
            take = _uniform(h, seed, run, step + 1) < d2 * scale.get(run, 0.0)
            return pd.DataFrame({"run": np.full(int(take.sum()), run, np.int32), "v": list(x[take])})

        more: dict = {}
        for r in _per_run(data, vec, {run: found[run] for run in scale}, sample, "run int, v array<double>").collect():
            more.setdefault(int(r["run"]), []).append(tuple(r["v"]))
        for run, rows in more.items():  # in a fixed order, whatever the partitions
            found[run] = np.vstack([found[run], np.unique(np.array(rows), axis=0)])

    def weigh(run, x, h, best, d2):
        at, n = np.unique(best, return_counts=True)
        return pd.DataFrame({"run": np.full(len(at), run, np.int32), "at": at.astype(np.int64), "n": n.astype(np.int64)})

    weights = {run: np.zeros(len(c)) for run, c in found.items()}
    for r in _per_run(data, vec, found, weigh, "run int, at long, n long").groupBy("run", "at").agg(F.sum("n").alias("n")) \
            .collect():
        weights[int(r["run"])][int(r["at"])] = r["n"]
    return {keys[run]: _plus_plus(c, weights[run], runs[keys[run]], np.random.default_rng([seed, run]))
            for run, c in found.items()}


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """Weighted k-means++ over a few candidates; with fewer than k different ones, all of them."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    d2 = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (weights * d2).sum() > 0:
        p = weights * d2
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        d2 = np.minimum(d2, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen].copy()


def kmeans_many(df: DataFrame, id_col: str, vec: str, ks, seed: int = 42, restarts: int = 20,
                max_iter: int = MAX_ROUNDS, tol: float = 1e-4) -> dict:
    """D1/D3 for several k: best of ``restarts`` converged K-means each, {k: (centres, inertia)}.

    All (k, restart) runs are seeded and moved in the same passes over the cached rows; a run that has converged
    (centres moved by less than ``tol`` times the mean variance in total squares) leaves the passes.
    """
    data = df.select(vec, F.xxhash64(id_col).alias("h")).filter(F.col(vec).isNotNull()).persist()
    stats = data.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if not stats[0]:
        data.unpersist()
        return {}
    spread = data.agg(*[F.var_pop(F.col(vec)[i]) for i in range(int(stats[1]))]).first()
    runs = {(int(k), r): int(k) for k in ks for r in range(restarts)}
    packed = _packed(data, vec)
    centres = _lloyd_rounds(packed, seed_many(data, vec, runs, seed), max_iter, tol * float(np.mean(spread)), total=True)
    cost = {run: 0.0 for run in runs}
    for r in _sums_many(packed, centres):
        cost[r["key"]] += r["w"]
    packed.unpersist()
    data.unpersist()
    best = {k: min((cost[run], run) for run in runs if run[0] == k)[1] for k in {run[0] for run in runs}}
    return {k: (centres[run], cost[run]) for k, run in sorted(best.items())}


def kmeans(df: DataFrame, id_col: str, vec: str, k: int = 6, seed: int = 42,
           restarts: int = 20, max_iter: int = MAX_ROUNDS, tol: float = 1e-4):
    """K-means, best of ``restarts`` starts by cost.

    Returns (assignments(id, cluster), centres ndarray, inertia).
    """
    centres, inertia = kmeans_many(df, id_col, vec, [k], seed, restarts, max_iter, tol)[k]
    return assign(df, id_col, vec, centres).select(id_col, "cluster"), centres, inertia


# ---------------------------------------------------------------------------
# Quality measures on (id, vec, cluster)
# ---------------------------------------------------------------------------

def cluster_summary(df: DataFrame, vec: str, cluster: str = "cluster"):
    """One pass of sums per cluster -> driver-side k x d summary.

    Returns dict with sizes (k,), centroids (k x d), wcss per cluster (k,),
    mean distance to centroid per cluster (k,), overall mean (d,), n.
    The second pass (distances to centroids) uses the broadcast centroids.
    """
    d = _dims(df, vec)
    cen = centres_of(df, vec, cluster, d).collect()
    ids = sorted(int(r[cluster]) for r in cen)
    pos = {c: i for i, c in enumerate(ids)}
    sizes = np.zeros(len(ids))
    cents = np.zeros((len(ids), d))
    for r in cen:
        sizes[pos[int(r[cluster])]] = r["n"]
        cents[pos[int(r[cluster])]] = np.asarray(r["centre"], dtype=np.float64)
    bc = df.sparkSession.sparkContext.broadcast((ids, cents))

    def kernel(batches):
        cid, cm = bc.value
        index = {c: i for i, c in enumerate(cid)}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf[vec])
            rows = np.array([index[int(c)] for c in pdf[cluster]])
            d2 = ((x - cm[rows]) ** 2).sum(axis=1)
            yield pd.DataFrame({cluster: pdf[cluster].astype(np.int64), "d2": d2, "d": np.sqrt(d2)})

    schema = T.StructType([T.StructField(cluster, T.LongType()), T.StructField("d2", T.DoubleType()),
                           T.StructField("d", T.DoubleType())])
    per = df.select(F.col(cluster).cast("long").alias(cluster), vec).mapInPandas(kernel, schema) \
        .groupBy(cluster).agg(F.sum("d2").alias("w"), F.avg("d").alias("s")).collect()
    w = np.zeros(len(ids))
    s = np.zeros(len(ids))
    for r in per:
        w[pos[int(r[cluster])]] = r["w"]
        s[pos[int(r[cluster])]] = r["s"]
    n = sizes.sum()
    overall = (cents * sizes[:, None]).sum(axis=0) / n if n else np.zeros(d)
    return {"ids": ids, "sizes": sizes, "centroids": cents, "wcss": w, "scatter": s,
            "overall": overall, "n": n}


def summary_metrics(summ) -> dict:
    """D5, D9, D10, D11 from a :func:`cluster_summary`."""
    sizes, cents, w, s, overall, n = (summ["sizes"], summ["centroids"], summ["wcss"],
                                      summ["scatter"], summ["overall"], summ["n"])
    k = len(sizes)
    wcss = float(w.sum())
    between = float((sizes * ((cents - overall) ** 2).sum(axis=1)).sum())
    if k < 2:
        ch = None
    elif wcss == 0:
        ch = 1.0
    else:
        ch = float((between / (k - 1)) / (wcss / (n - k)))
    if k < 2:
        db = None
    else:
        dist = np.sqrt(((cents[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (s[:, None] + s[None, :]) / np.where(dist == 0, np.inf, dist)
        np.fill_diagonal(ratio, -np.inf)
        db = float(np.mean(np.max(ratio, axis=1))) if np.any(s) and np.any(dist) else 0.0
    return {"wcss": wcss, "davies_bouldin_index": db, "calinski_harabasz_score": ch,
            "min_cluster_size": int(sizes.min()) if k else 0,
            "max_cluster_size": int(sizes.max()) if k else 0,
            "cluster_size_std": float(sizes.std()) if k else 0.0}


def wcss(df: DataFrame, vec: str, cluster: str = "cluster") -> float:
    return summary_metrics(cluster_summary(df, vec, cluster))["wcss"]


def davies_bouldin(df: DataFrame, vec: str, cluster: str = "cluster") -> float:
    return summary_metrics(cluster_summary(df, vec, cluster))["davies_bouldin_index"]


def calinski_harabasz(df: DataFrame, vec: str, cluster: str = "cluster") -> float:
    return summary_metrics(cluster_summary(df, vec, cluster))["calinski_harabasz_score"]


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Min / max / population std of the cluster sizes."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").cast("bigint").alias("min_cluster_size"),
                     F.max("n").cast("bigint").alias("max_cluster_size"),
                     F.stddev_pop("n").alias("cluster_size_std"))


def silhouette_samples(df: DataFrame, id_col: str, vec: str, cluster: str = "cluster",
                       block_rows: int | None = None) -> DataFrame:
    """(id, cluster, a, b, silhouette) with exact Euclidean distances.

    a = mean distance to the other members of the own cluster, b = smallest
    mean distance to another cluster, s = (b - a) / max(a, b); a singleton
    cluster scores 0.  Each pair of blocks of points gives k sums per point;
    the sums of a point over all blocks meet in one aggregation.  Rows without a
    vector take no part.
    """
    pts = df.select(id_col, vec, F.col(cluster).cast("long").alias("cluster")).filter(F.col(vec).isNotNull())
    sizes = {int(r["cluster"]): int(r["count"]) for r in pts.groupBy("cluster").count().collect()}
    cids = sorted(sizes)
    k, codes = len(cids), np.array(cids, dtype=np.int64)
    d = _dims(pts, vec)
    schema = T.StructType([T.StructField(id_col, pts.schema[id_col].dataType), T.StructField("cluster", T.LongType()),
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def member(block):
        out = np.zeros((len(block), k))
        out[np.arange(len(block)), np.searchsorted(codes, block.extra["cluster"].to_numpy())] = 1.0
        return out

    def task(pairs):
        for block, sums in summed_pairs(pairs, lambda x, y, same: distance_sums(x, y, same, member(x), member(y))):
            yield pa.table({id_col: block.ids, "cluster": block.extra["cluster"], "sums": _lists(sums)})

    allp = map_block_pairs(pts, id_col, vec, task, schema, ("cluster",), 8 * (d + 2 * k) + 16, block_rows) \
        .groupBy(id_col, "cluster").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(k)]).alias("sums"))
    # a: own cluster sum / (n_own - 1); b: min over other clusters of sum / n_c
    ids, counts = F.lit(cids).cast("array<bigint>"), F.lit([sizes[c] for c in cids]).cast("array<double>")
    place = F.array_position(ids, F.col("cluster")).cast("int")
    res = allp.select(id_col, "cluster", F.arrays_zip(F.col("sums").alias("s"), ids.alias("c"), counts.alias("n")).alias("m"),
                      F.element_at(counts, place).alias("n_own"), F.element_at("sums", place).alias("own"))
    b = F.array_min(F.transform(F.filter("m", lambda z: z["c"] != F.col("cluster")), lambda z: z["s"] / z["n"]))
    res = res.select(id_col, "cluster", F.when(F.col("n_own") > 1, F.col("own") / (F.col("n_own") - 1)).alias("a"),
                     b.alias("b"), "n_own")
    sil = F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0)) \
        .when(F.greatest("a", "b") == 0, F.lit(0.0)) \
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return res.select(id_col, "cluster", "a", "b", sil.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec: str, cluster: str = "cluster") -> float:
    """Mean silhouette."""
    s = silhouette_samples(df, id_col, vec, cluster)
    return float(s.agg(F.avg("silhouette")).first()[0])


def rank_within(df: DataFrame, key: str, order_cols: list, out: str = "pos") -> DataFrame:
    """0-based position of each row inside its ``key`` group, ordered by ``order_cols``.

    No per-key window: rows are range-partitioned on (key, order) so one
    large key spans many partitions, sorted inside each partition, and the
    layout is fixed with a reliable checkpoint.  Rows of a key are then
    numbered one after the other inside a partition, and a small table of rows
    per (partition, key) gives each partition its offset inside the key.
    ``order_cols`` (names or sort Columns such as ``F.desc(c)``) must make
    the order total (end with a unique id).
    """
    from notewise.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n_parts, key, *order_cols).sortWithinPartitions(key, *order_cols) \
        .withColumn("__rw_pid", F.spark_partition_id()).withColumn("__rw_row", F.monotonically_increasing_id()).checkpoint()
    counts = s.groupBy("__rw_pid", key).agg(F.count(F.lit(1)).alias("__rw_n"), F.min("__rw_row").alias("__rw_first"))
    w = Window.partitionBy(key).orderBy("__rw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__rw_pid", F.col(key).alias("__rw_key"), "__rw_first",
                         F.coalesce(F.sum("__rw_n").over(w), F.lit(0)).alias("__rw_off")) \
        .withColumnRenamed("__rw_pid", "__rw_p")
    # at most (partitions x keys) rows on the right: Spark picks the join by its size
    joined = s.join(offs, (F.col("__rw_pid") == F.col("__rw_p")) & F.col(key).eqNullSafe(F.col("__rw_key")))
    return joined.withColumn(out, (F.col("__rw_row") - F.col("__rw_first") + F.col("__rw_off")).cast("bigint")) \
        .drop("__rw_pid", "__rw_row", "__rw_p", "__rw_key", "__rw_first", "__rw_off")


def silhouette_squared(df: DataFrame, vec: str, cluster: str = "cluster") -> float:
    """D7, scalable variant: MLlib's silhouette with squared Euclidean distance.

    O(n k) instead of O(n^2) (cluster sums replace pairs), but a different
    measure from the exact Euclidean silhouette above; offered for inputs
    where the exact one is out of reach.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = vectors_for_ml(df.select(vec, F.col(cluster).cast("double").alias("_pred")), vec)
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="_pred",
                                     distanceMeasure="squaredEuclidean").evaluate(data))


def silhouette_profile(samples: DataFrame, id_col: str, gap: int = 10) -> DataFrame:
    """Plotting table: per cluster, scores ascending, stacked with a gap.

    y = offset of the cluster + position within it; the offset of cluster i
    is ``gap`` + sum over lower clusters of (size + gap).  Positions come
    from :func:`rank_within`, so a cluster holding most rows is still
    ranked by many tasks.
    """
    ranked = rank_within(samples.select(id_col, "cluster", "silhouette"), "cluster", ["silhouette", id_col])
    sizes = samples.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    ws = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    # one row per cluster: a global window over k rows is harmless
    offs = sizes.withColumn("y_lower", (F.lit(gap) + F.coalesce(F.sum(F.col("n") + F.lit(gap)).over(ws), F.lit(0)))
                            .cast("bigint"))
    return ranked.join(offs.select("cluster", "y_lower"), "cluster") \
        .select(id_col, "cluster", "pos", (F.col("y_lower") + F.col("pos")).alias("y"), "silhouette")


def representatives(df: DataFrame, id_col: str, vec: str, centres: np.ndarray) -> DataFrame:
    """For each centre, the row nearest to it over all rows; ties -> smaller id.

    Each task keeps only its local best per centre before the shuffle, so the
    exchange carries k rows per partition.
    """
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    id_type = df.schema[id_col].dataType

    def kernel(batches):
        c = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            d2 = squared_distances(_matrix(pdf[vec]), c)
            ids = pdf[id_col].to_numpy()
            rows = []
            for j in range(c.shape[0]):
                order = np.lexsort((ids, d2[:, j]))
                rows.append((j, float(d2[order[0], j]), ids[order[0]]))
            yield pd.DataFrame(rows, columns=["cluster", "dist2", id_col])

    schema = T.StructType([T.StructField("cluster", T.LongType()), T.StructField("dist2", T.DoubleType()),
                           T.StructField(id_col, id_type)])
    local = df.select(id_col, vec).mapInPandas(kernel, schema)
    return local.groupBy("cluster").agg(F.min(F.struct("dist2", id_col)).alias("b")) \
        .select("cluster", F.col(f"b.{id_col}").alias(id_col), F.sqrt("b.dist2").alias("distance"))


def project_2d(df: DataFrame, id_col: str, vec: str, k: int = 2) -> DataFrame:
    """2-D view of the vectors by MLlib PCA, signs fixed (largest |loading| > 0)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = vectors_for_ml(df.select(id_col, vec), vec)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    pcs = model.pc.toArray()
    signs = [1.0 if pcs[np.argmax(np.abs(pcs[:, j])), j] >= 0 else -1.0 for j in range(k)]
    return model.transform(data).select(
        id_col, *[(vector_to_array("pc")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])


# ---------------------------------------------------------------------------
# Many k at once.  A k sweep fits and measures 14 clusterings of the same
# rows; every data pass below serves all of them, so a round of Lloyd or a
# measure costs one scan whatever the number of k values.  Labels are always
# "nearest centre" (what both Lloyd and MLlib K-means assign).
# ---------------------------------------------------------------------------

def _labels(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return nearest(x, c)[0]


def _packed(df: DataFrame, vec: str):
    """The vectors as matrices of bounded size: a cached RDD, which every round of Lloyd reads without unpacking rows."""
    def kernel(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(pc.unique(pc.list_value_length(batch.column(0)))) > 1 or batch.column(0).null_count:
                raise ValueError("vectors are null or of different lengths")
            d = len(flat) // max(1, batch.num_rows)
            step = max(1, PACK_BYTES // (8 * max(1, d)))
            for at in range(0, batch.num_rows, step):
                n = min(step, batch.num_rows - at)
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()),
                                                  "mat": pa.array([flat[at * d:(at + n) * d].tobytes()], pa.binary())})

    return df.select(as_doubles(vec).alias("v")).mapInArrow(kernel, "n int, mat binary").rdd \
        .map(lambda r: np.frombuffer(r["mat"]).reshape(r["n"], -1)).persist(StorageLevel.MEMORY_AND_DISK)


def _sums_many(packed, centres: dict, centroids: dict | None = None) -> list[dict]:
    """One pass over :func:`_packed` rows: per (key, cluster) count, vector sum and cost (sum of squared distances).

    With ``centroids`` the cost is to the own centroid, and ``dsum`` sums the plain distances to it.  A task adds up
    its rows, so one matrix of sums a task is merged, in steps that keep the driver's share bounded.
    """
    # runs of equally many centres share one product
    same: dict = {}
    for key, c in centres.items():
        same.setdefault(len(c), []).append(key)
    d = next(iter(centres.values())).shape[1]
    width = sum(len(c) for c in centres.values())
    bc = packed.context.broadcast([(np.stack([np.asarray(centres[k], dtype=np.float64) for k in keys]),
                                    None if centroids is None else [centroids[k] for k in keys]) for keys in same.values()])

    def kernel(blocks):
        total = np.zeros((width, d + 3))  # n, w, dsum, then the vector sums
        for block in blocks:
            top = 0
            for c, own in bc.value:
                r, k = c.shape[:2]
                for part in row_slices(len(block), ROUND_SHARE * r * k):
                    x = block[part]
                    lab, d2 = (z.T for z in nearest_of_runs(x, c))
                    if own is not None:
                        d2 = np.stack([((x - o[lab[i]]) ** 2).sum(axis=1) for i, o in enumerate(own)])
                    member = np.empty((r, k, len(x)))
                    for j in range(k):
                        member[:, j] = lab == j
                    rows = slice(top, top + r * k)
                    total[rows, 0] += member.sum(2).ravel()
                    total[rows, 1] += (member @ d2[:, :, None]).ravel()
                    total[rows, 2] += (member @ np.sqrt(d2)[:, :, None]).ravel()
                    total[rows, 3:] += member.reshape(r * k, len(x)) @ x
                top += r * k
        yield total

    parts = packed.getNumPartitions()
    size = width * (d + 3) * 8
    depth = next((i for i in range(1, 5) if math.ceil(parts ** (1 / i)) * size <= PARTIAL_BYTES), 5)
    total = packed.mapPartitions(kernel).treeReduce(np.add, depth) if parts else np.zeros((width, d + 3))
    bc.destroy()
    out, top = [], 0
    for k, keys in same.items():
        for key in keys:
            out += [{"key": key, "cluster": j, "n": int(total[top + j, 0]), "s": total[top + j, 3:],
                     "w": float(total[top + j, 1]), "dsum": float(total[top + j, 2])}
                    for j in range(k) if total[top + j, 0] > 0]
            top += k
    return out


def lloyd_many(df: DataFrame, vec: str, inits: dict, iterations: int = MAX_ROUNDS, tol: float = 1e-12,
               total: bool = False) -> dict:
    """D1b for several runs together: one job per round for all that still move.

    A run ends when no centre moved by more than ``tol`` (``total``: when the squared moves of its centres sum to
    ``tol`` at most), or after ``iterations`` rounds.  An empty cluster keeps its centre.
    """
    packed = _packed(df, vec)
    centres = _lloyd_rounds(packed, inits, iterations, tol, total)
    packed.unpersist()
    return centres


def _lloyd_rounds(packed, inits: dict, iterations: int, tol: float, total: bool) -> dict:
    centres = {k: np.asarray(c, dtype=np.float64).copy() for k, c in inits.items()}
    moving = set(centres)
    for _ in range(iterations):
        if not moving:
            break
        new = {k: centres[k].copy() for k in moving}
        for r in _sums_many(packed, {k: centres[k] for k in centres if k in moving}):
            new[r["key"]][r["cluster"]] = r["s"] / r["n"]
        for k, c in new.items():
            step = np.sqrt(((c - centres[k]) ** 2).sum(axis=1))
            centres[k] = c
            if ((step**2).sum() if total else step.max(initial=0.0)) <= tol:
                moving.discard(k)
    return centres


def assign_many(df: DataFrame, id_col: str, vec: str, centres_by_k: dict) -> DataFrame:
    """(k, id, cluster) for every k: one pass emitting a row per (row, k)."""
    bc = df.sparkSession.sparkContext.broadcast({k: np.asarray(c, dtype=np.float64) for k, c in centres_by_k.items()})
    id_type = df.schema[id_col].dataType

    def kernel(batches):
        cents = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf[vec])
            ids = pdf[id_col].to_numpy()
            for k, c in cents.items():
                yield pd.DataFrame({"k": np.full(len(ids), k, dtype=np.int64), id_col: ids,
                                    "cluster": _labels(x, c).astype(np.int64)})

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField(id_col, id_type),
                           T.StructField("cluster", T.LongType())])
    return df.select(id_col, vec).mapInPandas(kernel, schema)


def measures_many(df: DataFrame, id_col: str, vec: str, centres_by_k: dict,
                  block_rows: int | None = None, with_silhouette: bool = True) -> list[dict]:
    """All per-k measures (D5-D7, D9-D11) for nearest-centre labelings.

    Pass 1: sizes and centroids per (k, cluster).  Pass 2: squared and plain
    distances to the centroids.  Silhouette (unless switched off): one
    block-pair join for every k together.
    """
    data = df.select(id_col, vec).persist()
    ks = sorted(centres_by_k)
    packed = _packed(data, vec)
    first = _sums_many(packed, centres_by_k)
    d = next(iter(centres_by_k.values())).shape[1]
    centroids = {k: np.zeros((centres_by_k[k].shape[0], d)) for k in ks}
    sizes = {k: np.zeros(centres_by_k[k].shape[0]) for k in ks}
    for r in first:
        k, j = r["key"], int(r["cluster"])
        sizes[k][j] = r["n"]
        centroids[k][j] = np.asarray(r["s"], dtype=np.float64) / r["n"]
    second = _sums_many(packed, centres_by_k, centroids)
    packed.unpersist()
    w = {k: np.zeros(centres_by_k[k].shape[0]) for k in ks}
    ssum = {k: np.zeros(centres_by_k[k].shape[0]) for k in ks}
    for r in second:
        k, j = r["key"], int(r["cluster"])
        w[k][j] = r["w"]
        ssum[k][j] = r["dsum"]
    sil = _silhouette_many(data, id_col, vec, centres_by_k, sizes, block_rows) if with_silhouette else {}
    out = []
    for k in ks:
        live = sizes[k] > 0
        summ = {"sizes": sizes[k][live], "centroids": centroids[k][live], "wcss": w[k][live],
                "scatter": ssum[k][live] / sizes[k][live], "n": sizes[k].sum()}
        summ["overall"] = (summ["centroids"] * summ["sizes"][:, None]).sum(axis=0) / summ["n"]
        out.append({"k": k, "silhouette_score": sil.get(k), **summary_metrics(summ)})
    data.unpersist()
    return out


def _silhouette_many(data: DataFrame, id_col: str, vec: str, centres_by_k: dict, sizes: dict,
                     block_rows: int | None = None) -> dict:
    """Mean silhouette per k: one block-pair join whose tasks sum the distances for every k with one product."""
    ks = sorted(centres_by_k)
    d = next(iter(centres_by_k.values())).shape[1]
    offsets = np.cumsum([0] + [centres_by_k[k].shape[0] for k in ks])
    total = int(offsets[-1])
    bc = data.sparkSession.sparkContext.broadcast(
        ({k: np.asarray(centres_by_k[k], dtype=np.float64) for k in ks},
         {k: np.asarray(sizes[k], dtype=np.float64) for k in ks}))
    schema = T.StructType([T.StructField(id_col, data.schema[id_col].dataType),
                           T.StructField("own", T.ArrayType(T.LongType())),
                           T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def member(block):
        cents, _ = bc.value
        return np.stack([offsets[i] + _labels(block.x, cents[k]) for i, k in enumerate(ks)], axis=1)

    def ones(labels):
        out = np.zeros((len(labels), total))
        np.put_along_axis(out, labels, 1.0, axis=1)
        return out

    def task(pairs):
        known = {}  # labels of the blocks: a block meets many others in a task

        def kernel(x, y, same):
            for block in (x, y):
                if block.number not in known:
                    known[block.number] = member(block)
            return distance_sums(x, y, same, ones(known[x.number]), ones(known[y.number]))

        for block, sums in summed_pairs(pairs, kernel):
            yield pa.table({id_col: block.ids, "own": _lists(known[block.number]), "sums": _lists(sums)})

    allp = map_block_pairs(data, id_col, vec, task, schema, (), 8 * (d + 2 * total) + 16, block_rows) \
        .groupBy(id_col).agg(F.first("own").alias("own"),
                             F.array(*[F.sum(F.col("sums")[i]) for i in range(total)]).alias("sums"))

    def score(batches):
        _, ss = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            own, sums = np.vstack(pdf["own"]), _matrix(pdf["sums"])
            rows = np.arange(len(pdf))
            out_s = []
            for i, k in enumerate(ks):
                lab = own[:, i] - offsets[i]
                blk = sums[:, offsets[i]:offsets[i + 1]]
                n_own = ss[k][lab]
                a = np.where(n_own > 1, blk[rows, lab] / np.maximum(n_own - 1, 1), 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean_other = blk / ss[k][None, :]
                mean_other[rows, lab] = np.inf
                mean_other[:, ss[k] == 0] = np.inf
                b = mean_other.min(axis=1)
                den = np.maximum(a, b)
                s = np.where((n_own <= 1) | ~np.isfinite(b) | (den == 0), 0.0,
                             (b - a) / np.where(den == 0, 1, den))
                out_s.append(float(s.sum()))
            yield pd.DataFrame({"k": np.array(ks, dtype=np.int64), "s": out_s, "n": len(pdf)})

    res = allp.select("own", "sums").mapInPandas(score, "k long, s double, n long").groupBy("k").agg(
        (F.sum("s") / F.sum("n")).alias("sil")).collect()
    bc.unpersist()
    return {int(r["k"]): float(r["sil"]) for r in res}
