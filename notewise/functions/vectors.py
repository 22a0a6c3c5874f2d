"""Vector maths on array<double> columns, evaluated in the JVM.

Spark 4.1 has no built-in dot product for arrays, so these are expressions
over higher-order array functions.  Inputs are cast to double first so that
float embeddings are summed in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(vec) -> Column:
    """array<float|double> -> array<double>."""
    return F.transform(_col(vec), lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector scores 0 (as the original tools do)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def sq_dist(a, b) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def euclid(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def r4(c) -> Column:
    """Round half up to 4 decimals on the binary value: floor(x*1e4+0.5)/1e4.

    The same text runs in DuckDB, so oracle comparisons agree on ties.
    """
    return (F.floor(_col(c) * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)).cast("double")
