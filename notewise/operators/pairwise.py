"""All-pairs work as a join of blocks on the executors.

Rows are dealt to blocks of bounded size by a hash of their id, and each block is packed
into one row (ids, a matrix, columns that the kernel needs).  The packed rows are written
once, to the checkpoint folder, in partitions of bounded size; Spark's cartesian product
then reads two partitions in a task, which meets their blocks pair by pair.  So rows are
shuffled and written once, however many blocks there are.  A task reduces its distances
at once, to sums per row or to the few pairs inside a radius; pairs of rows are only
written where they are the result.  Nothing passes through the driver, which only sees
the row count.

Squared distances come from the Gram form |x|^2 + |y|^2 - 2xy, one matrix product for a
slice of rows; where that cancels (near-equal rows) they are taken from the differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from notewise.session import checkpoint_dir

#: Bytes of a packed block's matrices.
BLOCK_BYTES = 4 << 20
#: Bytes of the packed blocks of a partition; a task reads two partitions.
PART_BYTES = 64 << 20
#: Bytes of the distances that a task holds at a time.
SLICE_BYTES = 16 << 20
#: Rows below which a block is not split further for the sake of parallelism.
LEAST_ROWS = 256
#: Share of |x|^2 + |y|^2 below which a squared distance is taken from the differences.
CANCEL = 1e-7


class Block:
    """Rows of a packed block: its number, ids (Arrow array), x (n x d), and the extra columns as Arrow arrays."""

    def __init__(self, number: int, ids: pa.Array, x: np.ndarray, extra: dict[str, pa.Array]):
        self.number, self.ids, self.x, self.extra = number, ids, x, extra

    def __len__(self) -> int:
        return len(self.x)

    def without_rows(self) -> Block:
        """Copies of the ids and the extra columns, which do not hold the block's batch."""
        copy = lambda v: v.take(pa.array(np.arange(len(v))))
        return Block(self.number, copy(self.ids), self.x[:0].copy(), {c: copy(v) for c, v in self.extra.items()})


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(len(x), len(y)) squared Euclidean distances, accurate for near-equal rows too."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    size = nx[:, None] + ny[None, :]
    d2 = size - 2.0 * (x @ y.T)
    rows, cols = np.nonzero(d2 <= CANCEL * size)
    step = max(1, SLICE_BYTES // (8 * max(1, x.shape[1])))
    for a in range(0, len(rows), step):
        i, j = rows[a:a + step], cols[a:a + step]
        diff = x[i] - y[j]
        d2[i, j] = (diff * diff).sum(1)
    return d2


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of ``c`` for each row of ``x`` (ties to the smaller index) and the squared distance to it."""
    d2 = squared_distances(x, c)
    best = d2.argmin(axis=1)
    if len(c) > 1 and len(x):
        # the Gram form can turn an exact tie over: settle near ties by the differences
        limit = d2[np.arange(len(x)), best] + 1e-9 * ((x * x).sum(1) + (c * c).sum(1).max())
        close = np.flatnonzero((d2 <= limit[:, None]).sum(1) > 1)
        step = max(1, SLICE_BYTES // (8 * max(1, c.size)))
        for a in range(0, len(close), step):
            rows = close[a:a + step]
            exact = ((x[rows][:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
            d2[rows] = exact
            best[rows] = exact.argmin(axis=1)
    return best, d2[np.arange(len(x)), best]


def nearest_of_runs(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest` for a stack of runs (r x k x d) in one product: labels and squared distances, (len(x), r) each."""
    r, k, d = c.shape
    nx, nc = (x * x).sum(1), (c * c).sum(2)
    # a plane of (run, row) per centre: the least of k planes takes no reduction along a short axis
    d2 = (c.reshape(r * k, d) @ x.T).reshape(r, k, len(x))
    d2 *= -2.0
    d2 += nc[:, :, None]
    d2 += nx
    best, low = np.zeros((r, len(x)), np.int64), d2[:, 0].copy()
    for j in range(1, k):
        np.copyto(best, j, where=d2[:, j] < low)
        np.minimum(low, d2[:, j], out=low)
    # the Gram form loses small distances and can turn an exact tie over: settle both by the differences
    limit = low + 1e-9 * (nx + nc.max(1)[:, None])
    close = np.zeros(low.shape, np.int64)
    for j in range(k):
        close += d2[:, j] <= limit
    run, rows = np.nonzero((close > 1) | (low <= CANCEL * (nx + np.take_along_axis(nc, best, axis=1))))
    step = max(1, SLICE_BYTES // (8 * max(1, k * d)))
    for a in range(0, len(rows), step):
        i, j = rows[a:a + step], run[a:a + step]
        exact = ((x[i][:, None, :] - c[j]) ** 2).sum(axis=2)
        best[j, i] = exact.argmin(axis=1)
        low[j, i] = exact.min(axis=1)
    return best.T, low.T


def row_slices(n: int, width: int):
    """Slices of ``n`` rows whose distances to ``width`` rows fit in SLICE_BYTES."""
    step = max(1, SLICE_BYTES // (8 * max(1, width)))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def _pack(table: pa.Table) -> pa.Table:
    lists = table.column("vec").combine_chunks()
    sizes = np.unique(pc.list_value_length(lists).to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("vectors hold null components")
    raw = np.ascontiguousarray(flat.to_numpy(), dtype=np.float64).tobytes()
    cols = {"block": table.column("block").slice(0, 1), "mat": pa.array([raw], pa.binary())}
    for name in table.column_names:
        if name not in ("block", "vec"):
            values = table.column(name).combine_chunks()
            cols[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table(cols)


def block_count(n: int, row_bytes: int, parallelism: int, block_rows: int | None = None) -> int:
    """Blocks for ``n`` rows: bounded bytes each, and enough pairs to occupy the cores."""
    if block_rows:
        return max(1, math.ceil(n / block_rows))
    by_bytes = math.ceil(n * row_bytes / BLOCK_BYTES)
    return max(1, by_bytes, min(math.ceil(n / LEAST_ROWS), math.ceil(math.sqrt(2 * parallelism))))


def _pack_blocks(df: DataFrame, id_col: str, vec: str, extra: tuple[str, ...], blocks: int,
                 parts: int | None = None) -> DataFrame:
    """(block, id, mat, x_...): one row per block, dealt by a hash of the id; ``parts`` sets the partitions."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"),
                     *[F.col(c).alias(f"x_{c}") for c in extra])
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("mat", T.BinaryType())]
        + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema if f.name != "vec"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    if parts:
        rows = rows.repartition(parts, "block")
    return rows.groupBy("block").applyInArrow(_pack, schema)


def _unpack(table: pa.Table | pa.RecordBatch, i: int, extra: tuple[str, ...], prefix: str = "") -> Block:
    def value(c):
        column = table.column(f"{prefix}{c}")
        return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[i]

    ids = value("id").values
    mat = np.frombuffer(value("mat").as_buffer(), np.float64).reshape(len(ids), -1)
    number = value("block").as_py() if f"{prefix}block" in table.schema.names else 0
    return Block(number, ids, mat, {c: value(f"x_{c}").values for c in extra})


def _size(df: DataFrame, vec: str) -> tuple[int, int]:
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    return n, d or 1


def map_block_pairs(df: DataFrame, id_col: str, vec: str, task: Callable, schema: T.StructType | str,
                    extra: tuple[str, ...] = (), row_bytes: int | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """Apply ``task(pairs) -> iterable of Arrow tables`` to the unordered pairs of blocks.

    ``pairs`` are the (a: Block, b: Block, same) of one task, each pair in one task; ``same`` marks a block met
    with itself.  Rows without a vector take no part; all vectors have one length.
    ``row_bytes`` is what a row costs in the task beside its id (default: its vector).
    """
    rows = df.filter(F.col(vec).isNotNull())
    n, d = _size(rows, vec)
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = block_count(n, row_bytes or 8 * d + 16, cores, block_rows)
    parts = min(blocks, max(math.ceil(n * (8 * d + 16) / PART_BYTES), math.ceil(math.sqrt(2 * cores))))
    checkpoint_dir(spark)
    packed = _pack_blocks(rows, id_col, vec, extra, blocks, parts).withColumn("part", F.spark_partition_id()).checkpoint()
    a, b = (packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    met = a.hint("shuffle_replicate_nl").join(b, (F.col("a_part") < F.col("b_part")) | (
        (F.col("a_part") == F.col("b_part")) & (F.col("a_block") <= F.col("b_block")))).drop("a_part", "b_part")
    arrow = to_arrow_schema(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))

    def pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = _unpack(batch, i, extra, "a_"), _unpack(batch, i, extra, "b_")
                yield (x, x, True) if x.number == y.number else (x, y, False)

    def run(batches):
        for table in task(pairs(batches)):
            yield from table.select(arrow.names).cast(arrow).to_batches()

    return met.mapInArrow(run, schema)


def map_block_grid(left: DataFrame, left_id: str, left_vec: str, right: DataFrame, right_id: str, right_vec: str,
                   kernel: Callable, schema: T.StructType | str, block_rows: int | None = None) -> DataFrame:
    """Apply ``kernel(a: Block, b: Block) -> iterable of Arrow tables`` to every (left block, right block)."""
    left, right = left.filter(F.col(left_vec).isNotNull()), right.filter(F.col(right_vec).isNotNull())
    cores = left.sparkSession.sparkContext.defaultParallelism
    (n, d), (m, e) = _size(left, left_vec), _size(right, right_vec)
    rows, cols = (block_count(x, 8 * y + 16, cores, block_rows) for x, y in ((n, d), (m, e)))
    a = _pack_blocks(left, left_id, left_vec, (), rows).withColumnRenamed("block", "row") \
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    b = _pack_blocks(right, right_id, right_vec, (), cols).withColumnRenamed("block", "col") \
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    arrow = to_arrow_schema(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return arrow.empty_table()
        found = kernel(_unpack(x, 0, ()), _unpack(y, 0, ()))
        return pa.concat_tables([arrow.empty_table(), *(t.select(arrow.names) for t in found)],
                                promote_options="permissive")

    return a.groupBy("row", "col").cogroup(b.groupBy("row", "col")).applyInArrow(run, schema)


def distance_sums(a: Block, b: Block, same: bool, member_a: np.ndarray, member_b: np.ndarray):
    """Per row of each block, its distances to the other block summed by the columns of the membership matrices."""
    to_a = np.zeros((len(a), member_b.shape[1]))
    to_b = np.zeros((len(b), member_a.shape[1]))
    for part in row_slices(len(a), len(b)):
        dist = np.sqrt(squared_distances(a.x[part], b.x))
        to_a[part] = dist @ member_b
        if not same:
            to_b += dist.T @ member_a[part]
    return (to_a, None) if same else (to_a, to_b)


def summed_pairs(pairs, kernel: Callable):
    """(block, sums) of a task's blocks, ``kernel(a, b, same)`` giving the (sums of a, sums of b) of a pair."""
    found: dict = {}
    for a, b, same in pairs:
        for block, sums in zip((a, b), kernel(a, b, same), strict=True):
            if sums is None:
                continue
            if block.number in found:
                found[block.number][1][:] += sums
            else:
                found[block.number] = (block.without_rows(), sums)
    yield from found.values()


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` are within ``eps``; distances near the radius are taken from the differences."""
    d2 = squared_distances(x, y)
    slack = eps * eps * 1e-9 + 1e-12 * ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]) + 1e-300
    near = d2 <= eps * eps + slack
    i, j = np.nonzero(near & (d2 >= eps * eps - slack))
    step = max(1, SLICE_BYTES // (8 * max(1, x.shape[1])))
    for at in range(0, len(i), step):
        p, q = i[at:at + step], j[at:at + step]
        near[p, q] = _distances(x, y, p, q) <= eps
    return near


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    diff = x[i] - y[j]
    return np.sqrt((diff * diff).sum(1))


def neighbour_counts(a: Block, b: Block, same: bool, eps: float):
    """Per row of each block, the rows of the other block within ``eps``."""
    to_a, to_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for part in row_slices(len(a), len(b)):
        near = _within(a.x[part], b.x, eps)
        to_a[part] = near.sum(1)
        to_b += near.sum(0)
    return (to_a, None) if same else (to_a, to_b)


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (a node's is a node of its component, never above it) after the edges (u, v) have joined components."""
    while True:
        lu, lv = label[u], label[v]
        apart = np.flatnonzero(lu != lv)
        if not len(apart):
            return label
        u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while not np.array_equal(label, up := label[label]):
            label = up


def core_links(pairs, core: str, eps: float):
    """(ids, core ids, distances) of a task's pairs of blocks: each row's nearest core within ``eps`` in a pair that
    has one, for rows that are no cores (ties to the smaller id); and, with null distances, cores with another core of
    their component in the task."""
    at, cores, label = {}, [], np.zeros(0, np.int64)  # nodes are numbered by block
    for a, b, same in pairs:
        is_core = [x.extra[core].to_numpy(zero_copy_only=False).astype(bool) for x in (a, b)]
        keys = [pc.fill_null(x.ids, 0).to_numpy() for x in (a, b)]
        for x in (a, b):
            if x.number not in at:
                at[x.number] = len(label)
                cores.append(x.without_rows().ids)
                label = np.concatenate([label, np.arange(len(label), len(label) + len(x))])
        for part in row_slices(len(a), len(b)):
            near = _within(a.x[part], b.x, eps)
            i, j = np.nonzero(near & is_core[0][part][:, None] & is_core[1][None, :])
            label = _joined(label, at[a.number] + part.start + i, at[b.number] + j)
            for flip in (False,) if same else (False, True):
                rows = ~is_core[1] if flip else ~is_core[0][part]
                to = is_core[0][part] if flip else is_core[1]
                r, c = np.nonzero((near.T if flip else near) & rows[:, None] & to[None, :])
                if not len(r):
                    continue
                p, q = (c + part.start, r) if flip else (r + part.start, c)
                dist = np.concatenate([_distances(a.x, b.x, p[k:k + 100_000], q[k:k + 100_000])
                                       for k in range(0, len(p), 100_000)])
                own, other, nb = (b, a, p) if flip else (a, b, q)
                row = q if flip else p
                order = np.lexsort((keys[0 if flip else 1][nb], dist, row))
                first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
                yield own.ids.take(pa.array(row[first])), other.ids.take(pa.array(nb[first])), pa.array(dist[first])
    ids = pa.concat_arrays(cores) if cores else None
    linked = np.flatnonzero(label != np.arange(len(label)))
    if len(linked):
        yield ids.take(pa.array(linked)), ids.take(pa.array(label[linked])), pa.nulls(len(linked), pa.float64())


def pairs_within(df: DataFrame, id_col: str, vec: str, eps: float, block_rows: int | None = None) -> DataFrame:
    """(id, nb, dist) for all ordered pairs within Euclidean ``eps``, each row with itself included.

    The output grows with the pairs inside the radius.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("nb", id_type),
                           T.StructField("dist", T.DoubleType())])

    def task(pairs):
        for a, b, same in pairs:
            for part in row_slices(len(a), len(b)):
                near = squared_distances(a.x[part], b.x) <= eps * eps * (1 + 1e-9) + 1e-300
                i, j = np.nonzero(near)
                i += part.start
                step = max(1, SLICE_BYTES // (8 * max(1, a.x.shape[1])))
                for at in range(0, len(i), step):
                    p, q = i[at:at + step], j[at:at + step]
                    diff = a.x[p] - b.x[q]
                    dist = np.sqrt((diff * diff).sum(1))
                    ok = dist <= eps
                    left, right, dist = a.ids.take(pa.array(p[ok])), b.ids.take(pa.array(q[ok])), pa.array(dist[ok])
                    yield pa.table({id_col: left, "nb": right, "dist": dist})
                    if not same:
                        yield pa.table({id_col: right, "nb": left, "dist": dist})

    return map_block_pairs(df, id_col, vec, task, schema, block_rows=block_rows)
