"""Text queries (A2, B1-B12, C1 TF-IDF search) over ``documents``/``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions.text import (NOTE_STOP_WORDS, NOUN_SUFFIX_RULES, coherence_stop_words,
                                     distinct_texts, note_tokens, preprocess_notes,
                                     word_tokens)
from notewise.functions.vectors import r4
from notewise.operators.ngrams import ngram_counts
from notewise.operators.search import tfidf_top_k
from notewise.plans.registry import R4, query
from notewise.sources.tables import load, text_column


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + "]"


def sql_note_tokens(col: str) -> str:
    """DuckDB text of :func:`note_tokens`."""
    return (f"list_filter(string_split(trim(lower(regexp_replace(coalesce({col}, ''), '[^A-Za-z]+', ' ', 'g'))), ' '), "
            f"lambda t: t <> '' AND length(t) >= 3 AND NOT list_contains({sql_list(NOTE_STOP_WORDS)}, t))")


def sql_word_tokens(col: str) -> str:
    """DuckDB text of :func:`word_tokens` (B9) with Spark's English stop words."""
    return (f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}_]+'), "
            f"lambda t: length(t) >= 2 AND length(t) <= 15 AND NOT list_contains({sql_list(coherence_stop_words())}, t))")


@query("note_text", "SELECT doc_id, CAST(text AS VARCHAR) AS text FROM documents")
def note_text(spark, sf_dir):
    """A2: the text column by position (documents: position 1), cast to string."""
    return text_column(load(spark, sf_dir, "documents", spread_by="doc_id"), pos=1, id_col="doc_id")


@query("clean_notes", f"""
SELECT doc_id, array_to_string(tk, ' ') AS clean_text, CAST(len(tk) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {sql_note_tokens('text')} AS tk FROM documents)
""")
def clean_notes(spark, sf_dir):
    """Letters only, lower, split, stop words, length > 2, re-join."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id")
    toks = note_tokens("text")
    return docs.select("doc_id", F.array_join(toks, " ").alias("clean_text"),
                       F.size(toks).cast("bigint").alias("n_tokens"))


def _rules_sql() -> str:
    return ", ".join(f"({i}, '{s}', '{r}')" for i, (s, r) in enumerate(NOUN_SUFFIX_RULES))


@query("clean_notes_lemma", f"""
WITH base AS (SELECT doc_id, {sql_note_tokens('text')} AS tk FROM documents),
ex AS (SELECT doc_id, unnest(tk) AS token, unnest(range(1, len(tk) + 1)) AS pos FROM base),
vocab AS (SELECT DISTINCT token FROM ex),
rules(ord, suf, rep) AS (VALUES {_rules_sql()}),
cand AS (SELECT v.token, r.ord, left(v.token, length(v.token) - length(r.suf)) || r.rep AS cand
         FROM vocab v JOIN rules r ON suffix(v.token, r.suf) AND length(v.token) > length(r.suf)),
hits AS (SELECT * FROM cand WHERE cand IN (SELECT token FROM vocab) AND cand <> token),
best AS (SELECT token, cand AS lemma FROM (
           SELECT *, row_number() OVER (PARTITION BY token ORDER BY length(cand), ord, cand) AS rn FROM hits)
         WHERE rn = 1 AND length(lemma) <= length(token)),
mapped AS (SELECT ex.doc_id, ex.pos, coalesce(best.lemma, ex.token) AS w FROM ex LEFT JOIN best USING (token)),
agg AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS s, count(*) AS n FROM mapped GROUP BY doc_id)
SELECT base.doc_id, coalesce(agg.s, '') AS clean_text, CAST(coalesce(agg.n, 0) AS BIGINT) AS n_tokens
FROM base LEFT JOIN agg USING (doc_id)
""")
def clean_notes_lemma(spark, sf_dir):
    """The whole note pipeline including vocabulary-checked lemmas."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id")
    out = preprocess_notes(docs, "doc_id", "text", lemmatize=True)
    return out.select("doc_id", "clean_text", F.size("tokens").cast("bigint").alias("n_tokens"))


@query("coherence_tokens", f"""
SELECT doc_id, array_to_string(tk, ' ') AS tokens, CAST(len(tk) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {sql_word_tokens('text')} AS tk FROM documents)
""")
def coherence_tokens(spark, sf_dir):
    """The coherence tokeniser (letters of any script, 2..15 chars, stop words out)."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id")
    toks = word_tokens("text")
    return docs.select("doc_id", F.array_join(toks, " ").alias("tokens"),
                       F.size(toks).cast("bigint").alias("n_tokens"))


@query("ngram_stats", f"""
WITH base AS (SELECT doc_id, {sql_note_tokens('text')} AS tk FROM documents),
g AS (SELECT n, array_to_string(tk[i:i + n - 1], ' ') AS gram
      FROM base, range(1, 11) r(n), LATERAL (SELECT unnest(range(1, len(tk) - n + 2)) AS i))
SELECT CAST(n AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_grams,
       CAST(count(DISTINCT gram) AS BIGINT) AS n_distinct, CAST(sum(length(gram)) AS BIGINT) AS total_chars
FROM g GROUP BY n
""")
def ngram_stats(spark, sf_dir):
    """Word 1..10-grams of every cleaned note, counted per n."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id")
    return ngram_counts(docs.select(note_tokens("text").alias("tk")), "tk", 10)


@query("distinct_notes", f"""
SELECT min(doc_id) AS query_id, clean_text, CAST(count(*) AS BIGINT) AS copies
FROM (SELECT doc_id, array_to_string({sql_note_tokens('text')}, ' ') AS clean_text FROM documents)
GROUP BY clean_text
""")
def distinct_notes(spark, sf_dir):
    """Distinct cleaned notes keyed by first occurrence, with their copy counts."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id").select("doc_id", F.array_join(note_tokens("text"), " ").alias("clean_text"))
    first = distinct_texts(docs, "doc_id", "clean_text")
    copies = docs.groupBy("clean_text").agg(F.count(F.lit(1)).cast("bigint").alias("copies"))
    return first.join(copies, "clean_text").select("query_id", "clean_text", "copies")


@query("tfidf_search", f"""
WITH toks AS (
  SELECT 0 AS side, doc_id AS doc, {sql_note_tokens('text')} AS tk FROM documents
  UNION ALL SELECT 1 AS side, item_id AS doc, {sql_note_tokens('text')} AS tk FROM benchmark),
ex AS (SELECT side, doc, unnest(tk) AS term FROM toks),
tf AS (SELECT side, doc, term, count(*) AS tf FROM ex GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM toks),
dfc AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w0 AS (SELECT tf.side, tf.doc, tf.term, tf.tf * ln((nd.n + 1.0) / (dfc.df + 1.0)) AS raw
       FROM tf JOIN dfc USING (term) CROSS JOIN nd),
w AS (SELECT side, doc, term, CASE WHEN nrm > 0 THEN raw / nrm ELSE 0.0 END AS w
      FROM (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY side, doc)) AS nrm FROM w0)),
sc AS (SELECT q.doc AS query_id, c.doc AS corpus_id, sum(q.w * c.w) AS score
       FROM w q JOIN w c ON q.term = c.term WHERE q.side = 0 AND c.side = 1 GROUP BY ALL),
allp AS (SELECT d.doc_id AS query_id, b.item_id AS corpus_id, coalesce(sc.score, 0.0) AS score
         FROM documents d CROSS JOIN benchmark b
         LEFT JOIN sc ON sc.query_id = d.doc_id AND sc.corpus_id = b.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rnk FROM allp)
SELECT query_id, CAST(rnk AS BIGINT) AS rank, corpus_id, {R4('score')} AS score FROM r WHERE rnk <= 5
""")
def tfidf_search(spark, sf_dir):
    """C1(b)+C4: every note against the whole benchmark table by TF-IDF cosine."""
    notes = load(spark, sf_dir, "documents", spread_by="doc_id").select("doc_id", note_tokens("text").alias("tokens"))
    corpus = load(spark, sf_dir, "benchmark").select("item_id", note_tokens("text").alias("tokens"))
    hits = tfidf_top_k(notes, corpus, "doc_id", "item_id", "tokens", k=5)
    return hits.select("query_id", "rank", "corpus_id", r4("score").alias("score"))
