"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions.vectors import r4
from notewise.operators.search import HASH_DIMS, semantic_search, similarity_vectors
from notewise.plans.fixtures import search_frames
from notewise.plans.q_text import sql_note_tokens
from notewise.plans.registry import R4, query
from notewise.sources.tables import array_to_dims, dims_to_array, load

_VECS = f"""
tok AS (SELECT 0 AS side, doc_id AS id, unnest({sql_note_tokens('text')}) AS t FROM documents
        UNION ALL SELECT 1, item_id, unnest({sql_note_tokens('text')}) FROM benchmark),
tf AS (SELECT side, id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {HASH_DIMS} AS b, count(*) AS n FROM tok GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) + 1.0::DOUBLE) / (count(*) + 1)) AS w
        FROM tf GROUP BY b),
wt AS MATERIALIZED (SELECT side, id, b, tf.n * idf.w AS x FROM tf JOIN idf USING (b)),
lens AS (SELECT side, id, sqrt(sum(x * x)) AS l FROM wt GROUP BY ALL),
dots AS (SELECT q.id AS qid, c.id AS cid, sum(q.x * c.x) AS d FROM wt q JOIN wt c ON q.b = c.b AND q.side = 0 AND c.side = 1
         GROUP BY ALL),
s AS MATERIALIZED (
  SELECT d.doc_id AS query_index, b.item_id AS corpus_id, round(coalesce(dots.d / nullif(lq.l * lc.l, 0), 0), 12) AS score
  FROM documents d CROSS JOIN benchmark b LEFT JOIN dots ON dots.qid = d.doc_id AND dots.cid = b.item_id
  LEFT JOIN lens lq ON lq.side = 0 AND lq.id = d.doc_id LEFT JOIN lens lc ON lc.side = 1 AND lc.id = b.item_id)
"""


@query("search_top5", f"""
WITH {_VECS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY score DESC, corpus_id) AS rnk FROM s)
SELECT r.query_index, CAST(r.rnk AS BIGINT) AS rank, r.corpus_id, b.text AS matched_sentence,
       {R4('r.score')} AS similarity_score
FROM r LEFT JOIN benchmark b ON b.item_id = r.corpus_id
WHERE r.rnk <= 5
""")
def search_top5(spark, sf_dir):
    """C1, C4-C7 + A5: top-5 theme sentences of every document, over all of ``benchmark`` (hashed TF-IDF vectors)."""
    notes, corpus = search_frames(spark, sf_dir)
    return semantic_search(notes, corpus, query_id="query_id", query_vec="embedding", corpus_id="item_id",
                           corpus_vec="embedding", corpus_text="text", k=5, digits=4)


@query("similarity_matrix", f"""
WITH {_VECS}
SELECT query_index, corpus_id, {R4('score')} AS score FROM s
""")
def similarity_matrix(spark, sf_dir):
    """Every note's cosine with every corpus row (long form of the vector)."""
    notes, corpus = search_frames(spark, sf_dir)
    sims = similarity_vectors(notes, corpus, "query_id", "embedding", "item_id", "embedding", out="sims")
    ids = corpus.agg(F.array_sort(F.collect_list("item_id")).alias("ids"))  # one row, as wide as a vector of scores
    return sims.crossJoin(ids).select(F.col("query_id").alias("query_index"), F.explode(F.arrays_zip("ids", "sims")).alias("z")) \
        .select("query_index", F.col("z.ids").alias("corpus_id"), r4("z.sims").alias("score"))


def _dims_sql(d: int) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dim_{i}" for i in range(d))
    return f"SELECT vec_id, {cols}, CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE) AS total FROM embeddings"


# Width of the given embeddings; the query takes it from the data.
EMB_DIMS = 64


@query("embedding_dims", _dims_sql(EMB_DIMS).replace(
    "CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE) AS total",
    R4("list_sum(CAST(embedding AS DOUBLE[]))") + " AS total"))
def embedding_dims(spark, sf_dir):
    """Array -> dim_0..dim_{d-1} columns and back (the round trip sums agree)."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    wide = array_to_dims(emb, "embedding")
    back = dims_to_array(wide, "dim_", out="vec")
    tot = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return wide.join(back.select("vec_id", r4(tot).alias("total")), "vec_id")
