"""Helpers shared by the operators: shared tables, ranks inside keys, components.

Lineage is cut by writing Parquet tables below ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs a re-read and no rework.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="notewise-llm-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result carries its path as ``shared_path`` for :func:`drop`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`put` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "shared_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"{name}_{uuid.uuid4().hex}"


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def rank_in_key(df: DataFrame, key: str, order: list[str], out: str = "rank_") -> DataFrame:
    """0-based rank of every row inside its ``key``, by ``order``; gapless.

    No key is gathered into one task: rows are range-partitioned by (key, order),
    each partition counts its rows of a key, and a running sum over partitions
    (one row for each partition and key in it) gives the offsets.  ``df`` should
    be narrow; it is written once to the shared folder, as the range bounds of
    two evaluations may differ.  Rows that agree in key and order get ranks in
    any order.
    """
    laid = put(
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [key, *order]])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [key, *order]])
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()), "ranked")
    sizes = laid.groupBy("_pid", key).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), "_first", "_before")
    joined = laid.join(sizes, (laid["_pid"] == sizes["_p"]) & laid[key].eqNullSafe(sizes["_k"]))
    return joined.withColumn(out, (F.col("_row") - F.col("_first") + F.col("_before")).cast("long")) \
        .drop("_p", "_k", "_first", "_before", "_pid", "_row")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of (a long, b long): one row (id, component) per node.

    ``component`` is the smallest id that is reachable.  Alternating large-star
    and small-star steps (Kiveris et al. 2014), each a map-side combined
    aggregate and a join, until the edge set no longer changes; a graph that has
    not settled after ``max_rounds`` raises.
    """
    def mark(t):
        return t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                     F.bit_xor(F.xxhash64("b", "a"))).first()

    # edges always point from the larger to the smaller id
    e = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a != b").distinct(), "edges")
    seen = mark(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # large star: every larger neighbour moves to the smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.select(F.col("a").alias("v"), F.col("b").alias("a")).join(low, "a") \
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
        # an edge (u, smaller v) also moves u itself to the smallest neighbour of u
        own = low.filter("m < a").select("a", F.col("m").alias("b"))
        step = large.union(own).filter("a != b").distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low2 = step.groupBy("a").agg(F.min("b").alias("m"))
        small = step.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(low2.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        new = put(small, "edges")
        now = mark(new)
        drop(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", "id"))
