"""Approximate nearest neighbours (Euclidean) by NN-descent and greedy graph search.

Equal vectors are one node.  The first lists of neighbours come from ``TABLES`` orders of
the nodes by the sides of random hyperplanes, cut into blocks that are compared whole.
NN-descent then joins neighbours of neighbours: every node (pivot) receives its
neighbours and up to ``REVERSE`` nodes that list it, compares them with one another where
one of the two is new, and sends a node the ones closer than its farthest neighbour.
Rounds end when fewer than ``DELTA`` of all list places are new.

A query holds a beam of its nearest nodes so far.  It starts from a fixed number of entry
nodes, and from its own node if it is one; each round joins the nearest nodes not yet
expanded with the graph, and their neighbours with the vectors.  A query ends when every
node of its beam has been expanded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.llm.common import drop, put, release
from notewise.llm.tokens import buffers

K = 10
#: Neighbours of a node, and nodes listing it that join with them (an index's degree; no candidate of a query is capped).
DEGREE = 20
REVERSE = 20
TABLES = 16
BLOCK = 2_048
BITS = 14
DELTA = 0.05
ROUNDS = 8
#: Nodes of the bounded sample: entry points of all queries, and medians of the hyperplanes.
ENTRIES = 1_024
BEAM = 128
WIDTH = 16
SEARCH_ROUNDS = 1_000
#: Bytes of vectors that a group of pivots or queries holds on average.
GROUP_BYTES = 8 << 20
SALTS = 16
SEED = 12

_EDGE = "node long, nbr long, d double"
_BEAM = "q long, vec binary, node array<long>, d array<double>, done array<boolean>"


def _vectors(column, kind) -> list[np.ndarray]:
    data, offsets = buffers(column)
    flat = np.frombuffer(data.tobytes(), kind)
    at = offsets // np.dtype(kind).itemsize
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_dim(column, kind):
    """(rows, matrix in double precision) for every length of vector in a column."""
    data, offsets = buffers(column)
    flat = np.frombuffer(data.tobytes(), kind)
    at = offsets // np.dtype(kind).itemsize
    dims = np.diff(at)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield rows, flat[at[rows][:, None] + np.arange(dim)].astype(np.float64)


def _scale(*x: np.ndarray) -> float:
    """Power of two that keeps squares in range; 1 for vectors of usual size."""
    most = max((float(np.abs(v).max(initial=0)) for v in x), default=0.0)
    return 1.0 if most == 0 or 1e-100 < most < 1e100 else 2.0 ** np.floor(np.log2(most) + 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, in double precision."""
    s = _scale(a, b)
    x = a / s - b / s if s != 1.0 else a - b
    return s * np.sqrt((x * x).sum(-1))


def _pack(kind):
    def run(batches):
        for batch in batches:
            v = batch.column("v")
            flat = np.asarray(v.flatten()).astype(kind)
            size = np.asarray(pc.list_value_length(v)).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(size))) * np.dtype(kind).itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size),
                                                   [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), raw.cast(pa.binary())], ["node", "vec"])
    return run


def _directions(dim: int, sample: dict, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes of vectors of a length, through the medians of the sample."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    w = rng.standard_normal((dim, tables * (BITS + 1)))
    return w, np.median(sample[dim] @ w, axis=0) if dim in sample else np.zeros(w.shape[1])


def _orders(kind, sample, tables: int):
    """Each node once per table, with its sides of the table's hyperplanes as one number."""
    def run(batches):
        for batch in batches:
            for rows, x in _by_dim(batch.column("vec"), kind):
                w, middle = _directions(x.shape[1], sample, tables)
                y = (x / _scale(x)) @ w - middle
                taken = batch.take(pa.array(rows))
                for t in range(tables):
                    part = y[:, t * (BITS + 1):(t + 1) * (BITS + 1)]
                    code = (part[:, :BITS] > 0) @ (1 << np.arange(BITS - 1, -1, -1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(np.full(len(rows), x.shape[1], np.int32)),
                         pa.array(code.astype(np.int64)), pa.array(part[:, BITS]), taken.column("node"),
                         taken.column("vec")], ["table", "dim", "code", "x", "node", "vec"])
    return run


def _block_edges(kind, degree: int, block: int):
    """Nearest neighbours inside consecutive blocks of an order."""
    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column("table")).astype(np.int64) << 32 | np.asarray(batch.column("dim"))
            nodes = np.asarray(batch.column("node"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces = max(1, round((b - a) / block))
                for part in np.array_split(np.arange(a, b), pieces):
                    if len(part) < 2:
                        continue
                    (_, x), = _by_dim(batch.column("vec").slice(int(part[0]), len(part)), kind)
                    y = x / _scale(x)
                    square = (y * y).sum(1)
                    far = square[:, None] + square[None, :] - 2 * y @ y.T
                    np.fill_diagonal(far, np.inf)
                    k = min(degree, len(part) - 1)
                    near = np.argpartition(far, k - 1, axis=1)[:, :k].ravel()
                    own = np.repeat(np.arange(len(part)), k)
                    yield pa.RecordBatch.from_pydict({"node": nodes[part][own], "nbr": nodes[part][near],
                                                      "d": _distance(x[own], x[near])})
    return run


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(node, nbrs): the ``degree`` nearest of all (node, nbr, d, fresh), each once, old where it was known before.

    The rank limit runs before the shuffle as well, so no node's candidates gather in one task.
    """
    order = Window.partitionBy("node").orderBy("d", "nbr")
    return edges.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= degree) \
        .groupBy("node", "d", "nbr").agg(F.min("fresh").alias("fresh")) \
        .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "nbr", "fresh"))).alias("nbrs"))


def _local_join(kind):
    """Compare the members of every pivot; give (node, nbr, d) where nbr may enter the list of node."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "ascending"), ("member", "ascending")])
        pivot, member, fresh, worst = (table.column(c).to_numpy() for c in ("pivot", "member", "fresh", "worst"))
        out = [[], [], []]
        for rows, x in _by_dim(table.column("vec"), kind):
            y = x / _scale(x)
            scale = _scale(x)
            starts = np.flatnonzero(np.concatenate(([True], np.diff(pivot[rows]) != 0)))
            sizes = np.diff(np.append(starts, len(rows)))
            wide = int(sizes.max())
            step = max(1, (1 << 21) // (wide * (x.shape[1] + wide)))
            for a in range(0, len(starts), step):
                first, size = starts[a:a + step], sizes[a:a + step]
                at = first[:, None] + np.arange(wide)[None, :]
                real = np.arange(wide)[None, :] < size[:, None]
                at = np.where(real, at, first[:, None])
                z = y[at]
                square = (z * z).sum(2)
                far = square[:, :, None] + square[:, None, :] - 2 * z @ z.transpose(0, 2, 1)
                new = fresh[rows][at]
                bound = (worst[rows][at] / scale) ** 2 * (1 + 1e-9) + 1e-12 * square.max(initial=0)
                ok = (far <= bound[:, :, None]) & real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :])
                ok &= ~np.eye(wide, dtype=bool)[None]
                p, i, j = np.nonzero(ok)
                i, j = at[p, i], at[p, j]
                d = _distance(x[i], x[j])
                i, j = rows[i], rows[j]
                closer = d <= worst[i]
                for kept, values in zip(out, (member[i], member[j], d), strict=True):
                    kept.append(values[closer])
        a, b, d = (np.concatenate(v) if v else np.zeros(0) for v in out)
        # a pair met at several pivots of this group counts once
        order = np.lexsort((b, a))
        a, b, d = a[order].astype(np.int64), b[order].astype(np.int64), d[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
        return pa.table({"node": a[keep], "nbr": b[keep], "d": d[keep]})
    return run


def build(nodes: DataFrame, kind, sample: dict, degree: int = DEGREE, reverse: int = REVERSE, block: int = BLOCK,
          tables: int = TABLES, delta: float = DELTA,
          rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """Neighbour graph (node, nbrs) of (node, vec), and the share of new list places after each round."""
    spark = nodes.sparkSession
    size = nodes.agg(F.count("*"), F.max(F.length("vec"))).first()
    orders = nodes.mapInArrow(_orders(kind, sample, tables), "table int, dim int, code long, x double, node long, vec binary")
    edges = orders.repartitionByRange("table", "dim", "code", "x").sortWithinPartitions("table", "dim", "code", "x") \
        .mapInArrow(_block_edges(kind, degree, block), _EDGE)
    graph = put(_nearest(edges.withColumn("fresh", F.lit(True)), degree), "graph")
    news = []
    groups = 1 + (size[0] or 0) * (degree + reverse) * ((size[1] or 0) + 40) // GROUP_BYTES
    for _ in range(rounds):
        known = graph.select("node", F.explode("nbrs").alias("e")).select("node", "e.nbr", "e.d", "e.fresh")
        listed = Window.partitionBy("nbr").orderBy(F.desc("fresh"), "d", "node")
        back = known.withColumn("rank", F.row_number().over(listed)).filter(F.col("rank") <= reverse)
        visits = known.select(F.col("node").alias("pivot"), F.col("nbr").alias("member"), "fresh").unionByName(
            back.select(F.col("nbr").alias("pivot"), F.col("node").alias("member"), "fresh"))
        # only pivots with a new member have work
        visits = visits.withColumn("any", F.max("fresh").over(Window.partitionBy("pivot"))).filter("any") \
            .groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
        worst = F.when(F.size("nbrs") < degree, F.lit(float("inf"))).otherwise(F.element_at("nbrs", -1)["d"])
        payload = nodes.join(graph.select("node", worst.alias("worst")), "node").withColumnRenamed("node", "member")
        met = visits.join(payload, "member").withColumn("group", F.pmod(F.xxhash64("pivot"), F.lit(groups)))
        found = met.groupBy("group").applyInArrow(_local_join(kind), _EDGE)
        both = found.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
        new = put(_nearest(both, degree), "graph")
        drop(graph)
        graph = new
        release(spark)
        share = graph.agg(F.sum(F.size(F.filter("nbrs", lambda e: e["fresh"]))) / F.sum(F.size("nbrs"))).first()[0]
        news.append(float(share or 0.0))
        if news[-1] < delta:
            break
    return graph, news


def _start(kind, entries: dict, beam: int):
    """First beam of every query: the nearest entry nodes, and its own node."""
    def run(batches):
        for batch in batches:
            q, own = np.asarray(batch.column("q")), batch.column("start").to_pylist()
            rows = []
            for k, x in enumerate(_vectors(batch.column("vec"), kind)):
                x = x.astype(np.float64)
                node, d = np.zeros(0, np.int64), np.zeros(0)
                if len(x) in entries:
                    node, points = entries[len(x)]
                    d = _distance(points, x[None, :])
                    near = np.lexsort((node, d))[:beam]
                    node, d = node[near], d[near]
                if own[k] is not None and own[k] not in node:
                    node, d = np.append(own[k], node)[:beam], np.append(0.0, d)[:beam]
                rows.append((int(q[k]), batch.column("vec")[k].as_py(), node.tolist(), d.tolist(), [False] * len(node)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())),
                 pa.array(cols[3], pa.list_(pa.float64())), pa.array(cols[4], pa.list_(pa.bool_()))],
                ["q", "vec", "node", "d", "done"])
    return run


def _advance(kind, beam: int, width: int):
    """Mark the expanded nodes of each beam and merge in the nodes they led to."""
    def run(found: pa.Table, beams: pa.Table) -> pa.Table:
        found = found.sort_by([("query", "ascending"), ("nbr", "ascending")])
        fq, fn = found.column("query").to_numpy(), found.column("nbr").to_numpy()
        data, offsets = buffers(found.column("nvec"))
        item = np.dtype(kind).itemsize
        rows = []
        for q, vec, node, d, done in zip(*(beams.column(c).to_pylist() for c in ("q", "vec", "node", "d", "done")),
                                         strict=True):
            node, d, done = np.array(node, np.int64), np.array(d, np.float64), np.array(done, bool)
            done[np.flatnonzero(~done)[:width]] = True
            a, b = np.searchsorted(fq, q, "left"), np.searchsorted(fq, q, "right")
            if b > a:
                x = np.frombuffer(vec, kind).astype(np.float64)
                points = np.frombuffer(data[offsets[a]:offsets[b]].tobytes(), kind)
                points = points.reshape(b - a, len(vec) // item).astype(np.float64)
                names, first = np.unique(fn[a:b], return_index=True)
                new = ~np.isin(names, node)
                names, points = names[new], points[first[new]]
                node = np.concatenate((node, names))
                d = np.concatenate((d, _distance(points, x[None, :])))
                done = np.concatenate((done, np.zeros(len(names), bool)))
                near = np.lexsort((node, d))[:beam]
                node, d, done = node[near], d[near], done[near]
            rows.append((q, vec, node.tolist(), d.tolist(), done.tolist()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({"q": pa.array(cols[0], pa.int64()), "vec": pa.array(cols[1], pa.binary()),
                         "node": pa.array(cols[2], pa.list_(pa.int64())), "d": pa.array(cols[3], pa.list_(pa.float64())),
                         "done": pa.array(cols[4], pa.list_(pa.bool_()))})
    return run


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, kind, entries: dict, beam: int = BEAM,
           width: int = WIDTH, reverse: int = REVERSE) -> DataFrame:
    """(q, node, d): the beam of every query (q, vec, start) after greedy search; ``start`` is a node or null."""
    spark = nodes.sparkSession
    known = graph.select("node", F.explode("nbrs").alias("e")).select("node", "e.nbr", "e.d")
    listed = Window.partitionBy("nbr").orderBy("d", "node")
    back = known.withColumn("rank", F.row_number().over(listed)).filter(F.col("rank") <= reverse)
    links = put(known.select("node", "nbr").unionByName(back.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")))
                .groupBy("node").agg(F.collect_set("nbr").alias("nbrs")), "links")
    beams = put(queries.mapInArrow(_start(kind, entries, beam), _BEAM), "beams")
    size = beams.agg(F.count("*"), F.max(F.length("vec"))).first()
    groups = 1 + size[0] * width * ((size[1] or 0) + 40) * 32 // GROUP_BYTES
    finished, n_open = [], size[0]
    for _ in range(SEARCH_ROUNDS):
        is_open = F.exists("done", lambda x: ~x)
        finished.append(beams.filter(~is_open).select("q", "node", "d"))
        active = beams.filter(is_open)
        n_open = active.count()
        if not n_open:
            break
        open_nodes = F.expr(f"slice(filter(node, (x, i) -> NOT done[i]), 1, {int(width)})")
        step = active.select("q", F.explode(open_nodes).alias("node")).join(links, "node") \
            .select(F.col("q").alias("query"), F.explode("nbrs").alias("nbr")).distinct()
        step = step.join(nodes.select(F.col("node").alias("nbr"), F.col("vec").alias("nvec")), "nbr") \
            .withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)))
        own = active.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)))
        beams = put(step.groupBy("group").cogroup(own.groupBy("group")).applyInArrow(_advance(kind, beam, width), _BEAM),
                    "beams")
    else:
        raise RuntimeError(f"{n_open} queries did not settle in {SEARCH_ROUNDS} rounds")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    release(spark)
    return out.select("q", F.explode(F.arrays_zip("node", "d")).alias("e")).select("q", "e.node", "e.d")


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
                       degree: int = DEGREE, reverse: int = REVERSE, entries: int = ENTRIES, beam: int = BEAM,
                       block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row whose id satisfies ``is_query``.

    ``is_query`` is a condition on the column vec_id.  The score is the Euclidean distance in double precision of
    the vectors as given; ties go to the smaller id; fewer candidates give fewer rows.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null id, take no part; vectors of different lengths are never compared.  Rows
    that repeat an id are one row (of several vectors, one).  Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) \
        & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    # + 0.0 turns -0.0 into 0.0, so equal vectors have equal keys
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .filter(usable).withColumn("v", F.transform(v, lambda x: x + F.lit(0.0))) \
        .withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(SEED), "v").alias("b")))
    ids = put(rows.groupBy("vec_id").agg(F.min("key").alias("key")), "ids")
    named = ids.groupBy("key").agg(F.min("vec_id").alias("node"))
    nodes = rows.groupBy("key").agg(F.first("v").alias("v")).join(named, "key").select("node", "v")
    nodes = put(nodes.mapInArrow(_pack(kind), "node long, vec binary"), "nodes")
    # k rows beside the query's own: of equal vectors no more than the k + 1 smallest ids can be among a query's k
    first = Window.partitionBy("key").orderBy("vec_id")
    members = ids.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1) \
        .groupBy("key").agg(F.collect_list("vec_id").alias("ids"))
    members = members.select(F.array_min("ids").alias("node"), "ids")

    sample, points = {}, nodes.orderBy(F.xxhash64("node"), "node").limit(entries).collect()
    for row in points:
        sample.setdefault(len(row["vec"]) // np.dtype(kind).itemsize, []).append(row)
    sample = {dim: (np.array([r["node"] for r in some], np.int64),
                    np.array([np.frombuffer(r["vec"], kind) for r in some], np.float64)) for dim, some in sample.items()}
    graph, _ = build(nodes, kind, {d: x / _scale(x) for d, (_, x) in sample.items()}, degree, reverse, block,
                     tables)

    asked = put(ids.filter(is_query).join(named, "key").select(F.col("vec_id").alias("query_id"), "node"), "asked")
    queries = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "vec",
                                                                         F.col("node").alias("start"))
    found = search(nodes, graph, queries, kind, sample, beam, WIDTH, reverse)
    near = found.join(members, "node").select("q", "d", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy("d", "vec_id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1) \
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    # many queries may hold the same vector: their join is split by salts
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")) \
        .join(near.withColumnRenamed("q", "node"), ["node", "salt"])
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
        F.col("e.d").alias("score"))
