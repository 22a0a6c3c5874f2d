"""Registered queries of the operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.llm.divergence_audit import source_divergence
from notewise.llm.embedding_dedup import near_embeddings
from notewise.llm.exact_dedup import exact_dedup
from notewise.llm.language_id import language_id
from notewise.llm.mixing import mix_sources
from notewise.llm.neighbour_graph import nearest_neighbours
from notewise.llm.ngram_join import ngram_join
from notewise.llm.packing import pack
from notewise.llm.prefix_trie import prefix_trie
from notewise.llm.quality import quality
from notewise.llm.sharding import shard_documents
from notewise.llm.substring_dedup import repeated_passages
from notewise.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    """Length buckets and batches of all documents."""
    return pack(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    """Classes of documents linked by shingle Jaccard 0.75 or more."""
    return ngram_join(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    """Copies of all documents; the largest doc_id stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    """Quality of all documents; source is the host, language the path below it."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    """Language of all documents."""
    return language_id(_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    """Place of every document in the mix of its sources."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    """All pages through ARC and WARC archives and back."""
    return archive_pages(_table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark, sf_dir):
    """Near copies among all embeddings."""
    return near_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark, sf_dir):
    """Shard and slot of all documents."""
    return shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", "grown_shard")


def op10_substring_dedup(spark, sf_dir):
    """Passages that repeat across all documents."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_divergence(spark, sf_dir):
    """Divergence of all sources inside their language."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_neighbours(spark, sf_dir):
    """The ten nearest of all embeddings to each row whose id is divisible by 100."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark, sf_dir):
    """Trie of all rebuilt conversations."""
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_exact_dedup, op4_quality, op5_language_id,
                                   op6_mixing, op7_warc, op8_embedding_dedup, op9_sharding, op10_substring_dedup,
                                   op11_divergence, op12_neighbours, op13_prefix_trie)}

_COMPONENTS = """
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""

ORACLE = {
    "op2_ngram_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT g FROM items GROUP BY g HAVING count(*) > 1),
met AS (SELECT i.* FROM items i JOIN shared USING (g)),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM met x JOIN met y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component AS component_id
FROM sets s JOIN classes c ON c.id = s.doc_id
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op8_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) >= 0.98 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))),
nodes AS (SELECT vec_id AS id FROM v),{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component AS component_id,
       id = component AS kept
FROM classes
""",
    "op11_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
hits AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM hits GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
met AS (SELECT lang, source, term, count(*) AS c FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(m.c, 0) AS c
  FROM groups g JOIN kept k USING (lang) LEFT JOIN met m USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 2))
         // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS HUGEINT) AS p
  FROM dense JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 2))
         // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS HUGEINT) AS q
  FROM dense JOIN sizes USING (lang) GROUP BY lang, term),
gaps AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN gaps ON gaps.lang = g.lang AND gaps.source = g.source AND gaps.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT)
  FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_prefix_trie": """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS crc FROM range(256) r(i)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda x: CAST(ascii(CAST(conv_id AS VARCHAR)[x]) AS BIGINT)),
         lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, t.i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.i < h
  UNION ALL
  SELECT c.conv_id, t.i, role, text FROM convs c JOIN turns t USING (conv_id) WHERE t.i >= h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, octet_length(encode(text)) AS bytes,
         sha256(length(role) || ':' || role || text) AS turn FROM rebuilt),
paths AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM placed
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
lens AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs,
         any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                                             FILTER (n = depth), '') AS ends
  FROM up JOIN lens USING (conv_id) GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
facts AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
below AS (
  SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM facts f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM facts f JOIN below USING (node) LEFT JOIN facts p ON p.node = f.parent
""",
}
