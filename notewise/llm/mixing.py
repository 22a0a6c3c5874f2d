"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order of their own, are cut into blocks of a fixed
number of rows.  Block k of a source with weight w (k from 0) is released at slot
floor(k / w) and due at ceil((k + 1) / w).  In every slot the released block with
the earliest deadline goes out (ties: the tie-breaks of PD2), which keeps every
source within less than one block of weight * slots at all times.

Weights are exact fractions (a float is the decimal that it prints as), so the
schedule repeats after their common denominator of slots.  The driver schedules one
period, or up to the slot in which a source runs out if that is earlier (with such
weights it holds one number per block), and Spark places every block by arithmetic.  When a source runs out, the others go on in a new phase with
their weights scaled up to one; nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import fresh, put, rank_in_key

BLOCK_ROWS = 16
#: Default target weight of a source: its number of blocks to this power, scaled to a sum of one.
ALPHA = 0.5


def quantise(weights: dict, quantum: int) -> dict:
    """Whole shares that sum to ``quantum`` (largest remainders), at least one for each source."""
    quantum = max(quantum, len(weights))
    names = sorted(weights, key=lambda s: (s is None, s))
    spare = quantum - len(names)
    total = sum(weights.values())
    ideal = {s: spare * weights[s] / total for s in names}
    shares = {s: 1 + int(ideal[s]) for s in names}
    left = quantum - sum(shares.values())
    for s in sorted(names, key=lambda s: (int(ideal[s]) - ideal[s], s is None, s))[:left]:
        shares[s] += 1
    return shares


def exact(weights: dict) -> dict:
    """The weights as whole shares of their sum, in lowest terms."""
    fractions = {s: Fraction(w) if isinstance(w, Rational) else Fraction(repr(float(w))) for s, w in weights.items()}
    total = sum(fractions.values())
    parts = {s: w / total for s, w in fractions.items()}
    period_ = lcm(*(w.denominator for w in parts.values()))
    return {s: int(w * period_) for s, w in parts.items()}


def period(shares: dict, blocks: dict | None = None) -> list:
    """Source of every slot of one period, by earliest deadline among released blocks.

    With ``blocks``, it ends after the slot in which a source gives the last of its blocks.

    With shares q out of Q, block k has release k*Q // q, deadline ceil((k+1)*Q / q).
    Ties go to blocks whose window overlaps the next one (b bit 1), then to the
    larger group deadline, then by name.
    """
    quantum = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, s))
    place = {s: i for i, s in enumerate(names)}

    def window(s, k):
        q = shares[s]
        return k * quantum // q, -(-(k + 1) * quantum // q)

    def entry(s, k):
        q = shares[s]
        release, due = window(s, k)
        overlaps = (k + 1) * quantum % q != 0
        group = 0
        if 2 * q >= quantum and q < quantum:
            # group deadline of a heavy source: the next slot at which a cascade of its windows must end,
            # a deadline of its complement (weight 1 - q/Q)
            rest = quantum - q
            group = -(-(due * rest // quantum + 1) * quantum // rest) if overlaps else 0
        return due, not overlaps, -group, place[s], k, release

    waiting = [(0, place[s], s, 0) for s in names]
    heapq.heapify(waiting)
    ready, out, slot = [], [], -1
    while len(out) < quantum:
        slot += 1
        while waiting and waiting[0][0] <= slot:
            _, _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (*entry(s, k), s))
        if not ready:
            raise AssertionError("an idle slot: shares do not fill the period")
        *_, k, _, s = heapq.heappop(ready)
        out.append(s)
        if blocks is not None and k + 1 >= blocks[s]:
            break
        heapq.heappush(waiting, (max(window(s, k + 1)[0], slot + 1), place[s], s, k + 1))
    return out


def phases(blocks: dict, weights: dict, quantum: int | None = None) -> list[dict]:
    """Phases until all blocks are out; each ends when a source has no block left.

    A phase has its first slot, its length, the period's slots of each source and
    the first block of each source.  There are no more phases than sources.  With
    ``quantum``, weights are rounded to multiples of 1 / quantum.
    """
    left, done, start, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    left = {s: n for s, n in left.items() if n > 0}
    while left:
        targets = {s: weights[s] for s in left}
        shares = exact(targets) if quantum is None else quantise(targets, quantum)
        slots = period(shares, left)
        at = {s: [] for s in left}
        for i, s in enumerate(slots):
            at[s].append(i)
        size = len(slots)
        # slot after which the first source has given its last block
        ends = {s: (n - 1) // len(at[s]) * size + at[s][(n - 1) % len(at[s])] + 1
                for s, n in left.items() if at[s]} if len(slots) == sum(shares.values()) else {None: size}
        length = min(ends.values())
        out.append({"start": start, "length": length, "size": size, "at": at, "first": {s: done[s] for s in left},
                    "shares": shares})
        for s in list(left):
            gone = length // size * len(at[s]) + sum(x < length % size for x in at[s])
            done[s] += gone
            left[s] -= gone
            if not left[s]:
                del left[s]
        start += length
    return out


def default_weights(blocks: dict, alpha: float = ALPHA) -> dict:
    total = sum(n ** alpha for n in blocks.values())
    return {s: n ** alpha / total for s, n in blocks.items()} if blocks else {}


def mix_sources(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS,
                quantum: int | None = None, alpha: float = ALPHA, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, block, slot, position, phase.

    ``block`` numbers a source's blocks in the order of doc_id, ``slot`` is the
    place of the block in the mix, ``position`` that of the row inside its block.
    ``weights`` maps every source to a positive target; without it a source
    weighs its blocks to the power ``alpha``.  A null source is a source of its
    own.  Sources and their block counts go to the driver: their number is that
    of the entries of the target mix.  With ``quantum``, weights are rounded to
    multiples of 1 / quantum; else the schedule is of the weights as given, and the
    driver holds the slots of a phase's period, at most one per block.  No rows in,
    no rows out.
    """
    spark = docs.sparkSession
    rows = rank_in_key(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(source_col).cast("string").alias("source")), "source", ["doc_id"])
    rows = rows.withColumn("block", F.expr(f"rank_ div {int(block_rows)}")) \
        .withColumn("position", (F.col("rank_") % block_rows).cast("int"))
    counts = {r["source"]: -(-r["n"] // block_rows) for r in
              docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        weights = default_weights(counts, alpha)
    missing = [s for s in counts if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"no positive weight for {missing[:5]}")
    plan, ids, places_, slots = [], [], [], []
    for p, phase in enumerate(phases(counts, weights, quantum)):
        for s, at in phase["at"].items():
            gone = phase["length"] // phase["size"] * len(at) + sum(x < phase["length"] % phase["size"] for x in at)
            if gone:
                ids += [len(plan)] * len(at)
                places_ += range(len(at))
                slots += at
                plan.append((s, p, phase["start"], phase["size"], phase["first"][s], phase["first"][s] + gone,
                             len(plan), len(at)))
    # Arrow tables stay in the JVM; a list of rows would start Python workers on the executors
    names = ("s_", "phase", "start_", "size_", "from_", "to_", "id_", "n_")
    kinds = (pa.string(), pa.int32(), *[pa.int64()] * 6)
    table = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in plan], kind)
                                            for i, (c, kind) in enumerate(zip(names, kinds, strict=True))}))
    at = spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in
                                         (("at_id", ids), ("at_k", places_), ("at_slot", slots))}))
    joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["s_"])
                       & (rows["block"] >= table["from_"]) & (rows["block"] < table["to_"])) \
        .withColumn("k_", F.col("block") - F.col("from_"))
    joined = joined.join(at, (F.col("id_") == F.col("at_id")) & (F.expr("k_ % n_") == F.col("at_k")))
    return joined.select("doc_id", "source", "block",
                         (F.col("start_") + F.expr("k_ div n_") * F.col("size_") + F.col("at_slot")).alias("slot"),
                         "position", "phase")


def places(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """Every id and source of ``docs``, under the names that these have there, with its slot and position in the mix.

    These two come third and fourth, under names that no column of ``docs`` has.
    Rows that repeat id and source share the first place that one of them has.
    """
    return put(mix_sources(docs, id_col=id_col, source_col=source_col, **options)
               .groupBy(F.col("doc_id").alias(id_col), F.col("source").alias(source_col))
               .agg(F.min("slot").alias(fresh("slot")), F.min("position").alias(fresh("position"))), "mix")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows of ``docs``, sorted by their place in the mix (files follow the schedule); columns of any name pass through."""
    found = places(docs, id_col, source_col, **options)
    slot, position = found.columns[2:]
    by_id, by_source = fresh("id"), fresh("source")
    order = found.withColumnsRenamed({id_col: by_id, source_col: by_source})
    met = docs.join(order, F.col(id_col).cast("long").eqNullSafe(F.col(by_id))
                    & F.col(source_col).cast("string").eqNullSafe(F.col(by_source)))
    return met.repartitionByRange(slot, position, F.col(by_id)) \
        .sortWithinPartitions(slot, position, by_id).select(*docs.columns)
