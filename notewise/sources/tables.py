"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Parquet test table ``name`` under ``sf_dir``.

    ``spread_by`` hash-partitions the scan on that key when it yields fewer
    partitions than the cluster has cores (see :func:`spread`).
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan on ``key`` when it has fewer splits than cores.

    A text table stored as one large row group scans as a single task; the
    per-note work (regex, tokens, n-grams) is CPU bound, so it is spread over
    the cluster first.  A scan that already has enough splits -- every
    large input -- is left alone, so no extra shuffle is paid at scale.  The
    key makes later per-note aggregations reuse this partitioning.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """A1: CSV with a header row (names may contain spaces) or parquet.

    Pass an explicit schema for CSV so no inference pass reads the data twice.
    """
    fmt = fmt or ("parquet" if path.endswith(".parquet") else "csv")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def text_column(df: DataFrame, pos: int = 3, id_col: str | None = None,
                out: str = "text") -> DataFrame:
    """A2: the column at position ``pos`` as a string, with an optional id."""
    name = df.columns[pos]
    cols = [F.col(id_col)] if id_col else []
    return df.select(*cols, F.col(f"`{name}`").cast("string").alias(out))


def dims_to_array(df: DataFrame, prefix: str = "dim_", out: str = "embedding") -> DataFrame:
    """Wide ``dim_0..dim_{d-1}`` columns -> one array<double> column."""
    dims = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()),
                  key=lambda c: int(c[len(prefix):]))
    rest = [c for c in df.columns if c not in dims]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in dims]).alias(out))


def array_to_dims(df: DataFrame, col: str, dim: int | None = None, prefix: str = "dim_") -> DataFrame:
    """Array column -> ``dim_0..dim_{dim-1}`` double columns; ``dim`` defaults to the longest array."""
    if dim is None:
        dim = int(df.agg(F.max(F.size(col))).first()[0] or 0)
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(F.col(col), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(dim)])


def write_csv(df: DataFrame, path: str, digits: int | None = None, mode: str = "overwrite") -> None:
    """A3: CSV with a header; doubles optionally written with fixed decimals.

    Written in parallel, one file per partition, like any Spark sink.
    """
    if digits is not None:
        df = df.select(*[
            F.format_string(f"%.{digits}f", F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields])
    df.write.mode(mode).option("header", True).csv(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist fitted parameters (coefficients, BLUPs, terms) as parquet."""
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
