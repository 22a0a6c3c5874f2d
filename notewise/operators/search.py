"""Embedding and similarity search.

A theme corpus within a byte bound (measured first) is shipped to every executor
once; notes stream past it partition by partition, one NumPy matrix product per
Arrow batch, so the search is a map-only stage with no shuffle.  A larger corpus
is never brought to the driver: blocks of notes meet blocks of corpus rows in a
shuffle (:func:`notewise.operators.pairwise.map_block_grid`), and a note's best rows
of all blocks are merged by a ranked limit that also runs before its shuffle.

Scores that agree to ``TIE_DIGITS`` decimals are ties, which go to the smaller
corpus id: sums in another order do not change ranks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.functions.vectors import as_doubles, r4
from notewise.operators.pairwise import map_block_grid, row_slices

#: Decimals to which scores are compared and reported before any further rounding.
TIE_DIGITS = 12
# Default bound on the bytes of corpus vectors shipped to each executor.
MAX_BROADCAST_BYTES = 256 << 20
#: Rows whose vectors and scores a worker holds at a time.
SLICE_ROWS = 1_000


def _round(col, digits):
    if digits is None:
        return col
    if digits == 4:
        return r4(col)
    s = float(10 ** digits)
    return (F.floor(col * F.lit(s) + F.lit(0.5)) / F.lit(s)).cast("double")


def _corpus_matrix(corpus: DataFrame, corpus_id: str, corpus_vec: str):
    """Collect a size-checked corpus chunk: ids (sorted) and a float64 matrix."""
    pdf = corpus.select(F.col(corpus_id).cast("long").alias("id"),
                        as_doubles(corpus_vec).alias("v")).toPandas()
    pdf = pdf.sort_values("id", kind="stable")
    ids = pdf["id"].to_numpy(dtype=np.int64)
    mat = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["v"]]) if len(pdf) else np.zeros((0, 0))
    return ids, mat


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)


def _vector_slices(batches):
    """(ids, matrix) of at most SLICE_ROWS rows of (id, vector) batches: a worker holds no more at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            if len(pc.unique(pc.list_value_length(part.column(1)))) > 1 or part.column(1).null_count:
                raise ValueError("vectors are null or of different lengths")
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def fits_broadcast(corpus: DataFrame, corpus_vec: str, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether rows x dims of the corpus are within the bound."""
    n, d = corpus.select(F.count(F.lit(1)), F.max(F.size(corpus_vec))).first()
    return n * (max(d or 0, 1) * 8 + 16) <= max_bytes


def similarity_vectors(queries: DataFrame, corpus: DataFrame, query_id: str, query_vec: str,
                       corpus_id: str = "item_id", corpus_vec: str = "embedding",
                       out: str = "sims", max_bytes: int = MAX_BROADCAST_BYTES,
                       block_rows: int | None = None) -> DataFrame:
    """(query_id, out array<double>) -- cosine with every corpus row, by corpus id.

    A row holds one score per corpus row.  With a corpus above the bound the pieces of a row come from the
    blocks of the corpus and are put in the order of the ids by one aggregation; query ids are unique then.
    """
    qtype = queries.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, qtype), T.StructField(out, T.ArrayType(T.DoubleType()))])
    if not fits_broadcast(corpus, corpus_vec, max_bytes):
        piece = T.StructType([T.StructField(query_id, qtype), T.StructField("ids", T.ArrayType(T.LongType())),
                              T.StructField("s", T.ArrayType(T.DoubleType()))])

        def grid(a, b):
            scores = np.round(_unit_rows(a.x) @ _unit_rows(b.x).T, TIE_DIGITS)
            width = pa.array(np.arange(len(a) + 1) * len(b), pa.int32())
            yield pa.table({query_id: a.ids, "ids": pa.ListArray.from_arrays(width, pa.array(np.tile(b.ids.to_numpy(), len(a)))),
                            "s": pa.ListArray.from_arrays(width, pa.array(scores.ravel()))})

        keyed = corpus.select(F.col(corpus_id).cast("long").alias("id"), corpus_vec)
        parts = map_block_grid(queries, query_id, query_vec, keyed, "id", corpus_vec, grid, piece, block_rows)
        rows = parts.select(query_id, F.arrays_zip("ids", "s").alias("z")).groupBy(query_id) \
            .agg(F.array_sort(F.flatten(F.collect_list("z"))).alias("z"))
        return rows.select(query_id, F.transform("z", lambda z: z["s"]).alias(out))
    _, mat = _corpus_matrix(corpus, corpus_id, corpus_vec)
    bc = queries.sparkSession.sparkContext.broadcast(_unit_rows(mat))

    def kernel(batches):
        cm = bc.value
        for ids, x in _vector_slices(batches):
            sims = np.round(_unit_rows(x) @ cm.T, TIE_DIGITS)
            at = pa.array(np.arange(len(sims) + 1) * sims.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, pa.array(sims.ravel()))], [query_id, out])

    return queries.select(query_id, as_doubles(query_vec).alias(query_vec)).mapInArrow(kernel, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Per row the k best columns, ties to the smaller id: (columns, scores).  ``ids`` ascend."""
    s = np.round(scores, TIE_DIGITS)
    order = np.argsort(-s, axis=1, kind="stable")[:, :min(k, len(ids))]
    return order, np.take_along_axis(s, order, axis=1)


def top_k(queries: DataFrame, corpus: DataFrame, query_id: str, query_vec: str,
          corpus_id: str = "item_id", corpus_vec: str = "embedding", k: int = 5,
          max_bytes: int = MAX_BROADCAST_BYTES, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, corpus_id, score), k = min(k, corpus size); ties go to the smaller corpus id.

    Above the bound query ids are unique; rows without a vector have no hits.
    """
    qtype = queries.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, qtype), T.StructField("rank", T.LongType()),
                           T.StructField("corpus_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not fits_broadcast(corpus, corpus_vec, max_bytes):
        def grid(a, b):
            order = np.argsort(b.ids.to_numpy(), kind="stable")
            ids, y = b.ids.to_numpy()[order], _unit_rows(b.x[order])
            for part in row_slices(len(a), len(b)):
                at, s = _best(_unit_rows(a.x[part]) @ y.T, ids, k)
                yield pa.table({query_id: a.ids.take(pa.array(np.repeat(np.arange(part.start, part.stop), at.shape[1]))),
                                "rank": np.zeros(at.size, np.int64), "corpus_id": ids[at].ravel(), "score": s.ravel()})

        keyed = corpus.select(F.col(corpus_id).cast("long").alias("id"), corpus_vec)
        found = map_block_grid(queries, query_id, query_vec, keyed, "id", corpus_vec, grid, schema, block_rows)
        best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("corpus_id"))
        return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    ids, mat = _corpus_matrix(corpus, corpus_id, corpus_vec)
    bc = queries.sparkSession.sparkContext.broadcast((ids, _unit_rows(mat)))

    def kernel(batches):
        cid, cm = bc.value
        kk = min(k, len(cid))
        for qid, x in _vector_slices(batches):
            if kk == 0:
                continue
            order, top = _best(_unit_rows(x) @ cm.T, cid, k)
            nq = len(x)
            yield pa.RecordBatch.from_pydict({
                query_id: qid.take(pa.array(np.repeat(np.arange(nq), kk))),
                "rank": np.tile(np.arange(1, kk + 1, dtype=np.int64), nq),
                "corpus_id": cid[order].reshape(-1),
                "score": top.reshape(-1),
            })

    return queries.select(query_id, as_doubles(query_vec).alias(query_vec)).mapInArrow(kernel, schema)


def semantic_search(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id",
                    query_vec: str = "embedding", corpus_id: str = "item_id",
                    corpus_vec: str = "embedding", query_text: str | None = None,
                    corpus_text: str | None = "text", k: int = 5,
                    digits: int | None = 4) -> DataFrame:
    """Long results table, one row per (note, rank).

    Columns: query_index, [query_text], rank, corpus_id, [matched_sentence],
    similarity_score (rounded half-up to ``digits``).
    """
    hits = top_k(queries, corpus, query_id, query_vec, corpus_id, corpus_vec, k)
    out = hits.select(F.col(query_id).alias("query_index"), "rank", "corpus_id",
                      _round(F.col("score"), digits).alias("similarity_score"))
    if query_text:
        out = out.join(queries.select(F.col(query_id).alias("query_index"),
                                      F.col(query_text).alias("query_text")), "query_index")
    if corpus_text:
        # Spark broadcasts the texts when their measured size allows it
        texts = corpus.select(F.col(corpus_id).cast("long").alias("corpus_id"),
                              F.col(corpus_text).alias("matched_sentence"))
        out = out.join(texts, "corpus_id", "left")
    cols = ["query_index"] + (["query_text"] if query_text else []) + ["rank", "corpus_id"] \
        + (["matched_sentence"] if corpus_text else []) + ["similarity_score"]
    return out.select(*cols)


# ---------------------------------------------------------------------------
# Embedding providers.  The original used a sentence encoder per note; on
# Spark we offer (a) vectors already in a column, (b) exact sparse TF-IDF over
# the cleaned tokens with cosine by an inverted-index join, (c) a caller
# encoder applied per Arrow batch to distinct texts only, (d) hashed TF-IDF,
# a vector column from the tokens alone.
# ---------------------------------------------------------------------------

HASH_DIMS = 1024


def _hashed_counts(column: pa.Array, dims: int) -> np.ndarray:
    """(texts, dims) token counts; a token's place is its MD5 (first 32 bits) modulo ``dims``."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    coded = column.flatten().dictionary_encode()
    place = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims for t in coded.dictionary.to_pylist()],
                     dtype=np.int64)
    out = np.zeros((len(sizes), dims))
    if len(place):
        np.add.at(out, (np.repeat(np.arange(len(sizes)), sizes), place[np.asarray(coded.indices)]), 1.0)
    return out


def hash_idf(frames: list[DataFrame], tokens_col: str = "tokens", dims: int = HASH_DIMS) -> np.ndarray:
    """C1(d), fit: ln((N + 1) / (texts with the place + 1)) per place, over all rows of ``frames``.

    Each task sends one row of ``dims`` counts for a batch; nothing else is shuffled or collected.
    """
    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.column(0).slice(at, 1_000)
                df = (_hashed_counts(part, dims) > 0).sum(0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([df.tolist()])], ["n", "df"])

    rows = [f.select(tokens_col).mapInArrow(kernel, "n long, df array<long>") for f in frames]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    total = every.select("n", F.posexplode("df").alias("place", "df")).groupBy("place") \
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()
    out = np.zeros(dims)
    for r in total:
        out[r["place"]] = np.log((r["n"] + 1.0) / (r["df"] + 1.0))
    return out


def hash_vectors(df: DataFrame, id_col: str, tokens_col: str, idf: np.ndarray, out: str = "embedding") -> DataFrame:
    """C1(d), apply: (id, out array<double>) -- counts times ``idf``, unit length; no tokens give a zero vector.

    A map over Arrow batches without a shuffle.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    dims = len(idf)

    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x = _unit_rows(_hashed_counts(part.column(1), dims) * idf)
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vecs], [id_col, out])

    return df.select(id_col, tokens_col).mapInArrow(kernel, schema)


def tfidf_weights(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, term, w): L2-normalised tf * idf, idf = ln((N+1)/(df+1)).

    N and df are counted over ``docs`` (one row per document id); one output
    row per (document, term).  Document frequency is a partial aggregation
    per term joined back (a term found in every document stays one row per
    task before the shuffle; AQE splits its side of the join if it is hot);
    the norm is a window over one document's terms.
    """
    n_docs = docs.count()
    tf = docs.select(id_col, F.explode(tokens_col).alias("term")).groupBy(id_col, "term") \
        .agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df_, "term").withColumn(
        "raw", F.col("tf") * F.log(F.lit(float(n_docs + 1)) / (F.col("df") + F.lit(1.0))))
    nrm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", F.when(nrm > 0, F.col("raw") / nrm).otherwise(F.lit(0.0)).alias("w"))


def tfidf_top_k(notes: DataFrame, corpus: DataFrame, note_id: str, corpus_id: str,
                tokens_col: str = "tokens", k: int = 5) -> DataFrame:
    """C1(b)+C4: top-k corpus rows per note by TF-IDF cosine.

    Term statistics come from notes and corpus together.  Scores are sums of
    weight products over shared terms: an equi-join on the term (corpus side
    broadcast when small), then a sum per (note, corpus row).  Pairs with no
    shared term score 0 and only fill ranks when fewer than k rows share one.
    """
    both = notes.select(F.col(note_id).cast("long").alias("doc"), F.lit(0).alias("side"), tokens_col) \
        .unionByName(corpus.select(F.col(corpus_id).cast("long").alias("doc"), F.lit(1).alias("side"), tokens_col))
    both = both.withColumn("key", F.struct("side", "doc"))
    # both sides read the same weights: compute them once
    w = tfidf_weights(both, "key", tokens_col).persist()
    qw = w.filter(F.col("key.side") == 0).select(F.col("key.doc").alias("query_id"), "term", F.col("w").alias("qw"))
    cw = w.filter(F.col("key.side") == 1).select(F.col("key.doc").alias("corpus_id"), "term", F.col("w").alias("cw"))
    # the corpus side is small by role; hint the broadcast only when its
    # (document, term) rows are within the bound
    cw_rows = cw.count()
    cw_side = F.broadcast(cw) if cw_rows * 64 <= MAX_BROADCAST_BYTES else cw
    scores = qw.join(cw_side, "term").groupBy("query_id", "corpus_id").agg(F.sum(F.col("qw") * F.col("cw")).alias("score"))
    # Every corpus row is a candidate (score 0 when nothing is shared): a
    # note keeps its k best from the shared-term scores plus zero fillers
    # taken in corpus id order.  The corpus is bounded (checked), so its ids
    # travel as a literal array.
    n_corpus = corpus.count()
    if n_corpus * 8 > MAX_BROADCAST_BYTES:
        raise ValueError("corpus too large for zero-score filling")
    ids = sorted(int(r[0]) for r in corpus.select(F.col(corpus_id).cast("long")).collect())
    base = notes.select(F.col(note_id).cast("long").alias("query_id"),
                        F.lit(ids).cast("array<bigint>").alias("ids"))
    nz = scores.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"),
                                                                 F.col("corpus_id").alias("id"))).alias("nz"))
    j = base.join(nz, "query_id", "left")
    nzs = F.coalesce(F.col("nz"), F.array().cast("array<struct<neg:double,id:bigint>>"))
    pos = F.filter(nzs, lambda s: s["neg"] < 0)
    # Fillers are only needed when fewer than k rows share a term; then the
    # first 2k corpus ids always hold k ids without a positive score, so the
    # exclusion check is O(k^2) per note whatever the corpus size.
    fill = F.when(F.size(pos) >= k, F.array().cast("array<struct<neg:double,id:bigint>>")).otherwise(
        F.transform(F.filter(F.slice("ids", 1, 2 * k), lambda i: ~F.exists(pos, lambda s: s["id"] == i)),
                    lambda i: F.struct(F.lit(0.0).alias("neg"), i.alias("id"))))
    cand = F.slice(F.array_sort(F.concat(pos, fill)), 1, k)
    return j.select("query_id", F.posexplode(cand).alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("t.id").alias("corpus_id"),
        (-F.col("t.neg") + F.lit(0.0)).alias("score"))


def embed_with(df: DataFrame, id_col: str, text_col: str, encoder, dim: int,
               out: str = "embedding") -> DataFrame:
    """C1(c): run a caller encoder ``encoder(list[str]) -> array (n, dim)``.

    Only distinct texts are encoded (one shuffle on the text), each Arrow
    batch is one encoder call, and vectors are joined back to every row.
    """
    # a missing text is encoded as the empty text
    keyed = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    distinct = keyed.select(text_col).distinct()

    def kernel(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = np.asarray(encoder(pdf[text_col].fillna("").tolist()), dtype=np.float64)
            yield pd.DataFrame({text_col: pdf[text_col], out: list(vecs)})

    schema = T.StructType([T.StructField(text_col, T.StringType()),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    vecs = distinct.mapInPandas(kernel, schema)
    return keyed.join(vecs, text_col, "left")
