"""Text preparation as Spark column expressions (no Python UDF in the hot path).

Everything here runs inside the JVM: regex replace, lower, split and
higher-order array functions.  A note is processed whole, never a prefix.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The English stop-word list applied before lemmatising
# (the 179-word list of the NLTK "english" corpus, in its natural order).
# ---------------------------------------------------------------------------
NOTE_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven",
    "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Noun suffix rules (suffix, replacement) tried when lemmatising,
# in the order they are tried.
NOUN_SUFFIX_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]


# Default stop words of the coherence tokeniser -- Spark's own
# English list (``StopWordsRemover.loadDefaultStopWords("english")``, 181
# words, natural order).  Written out so SQL oracles can be built without a
# running JVM.
SPARK_ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's",
    "we're", "they're", "i've", "we've", "you've", "they've", "isn't",
    "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't",
    "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's",
    "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
]


def coherence_stop_words() -> list[str]:
    """Default stop words for the coherence tokeniser (a parameter of :func:`word_tokens`)."""
    return list(SPARK_ENGLISH_STOP_WORDS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters_only(text) -> Column:
    """B1: every character outside A-Z/a-z becomes a separator."""
    return F.regexp_replace(_col(text), "[^A-Za-z]+", " ")


def lower_ascii(text) -> Column:
    """B2: lower-case (applied after :func:`letters_only`, so ASCII only)."""
    return F.lower(_col(text))


def split_tokens(text) -> Column:
    """Whitespace tokenise and drop empty strings."""
    return F.filter(F.split(F.trim(_col(text)), " +"), lambda t: t != F.lit(""))


def drop_stop_words(tokens, stop_words: Iterable[str]) -> Column:
    """Remove stop words, keeping order and repeats (not a set difference).

    ``isin`` with a long literal list becomes a hash-set lookup (InSet) in
    the optimiser, also inside the lambda: one probe per token instead of a
    scan of the list.
    """
    stops = sorted(set(stop_words))
    return F.filter(_col(tokens), lambda t: ~t.isin(stops))


def drop_short(tokens, min_len: int = 3) -> Column:
    """Keep tokens of at least ``min_len`` characters."""
    return F.filter(_col(tokens), lambda t: F.length(t) >= min_len)


def join_tokens(tokens) -> Column:
    """Re-join with one space."""
    return F.array_join(_col(tokens), " ")


def note_tokens(text, stop_words: Iterable[str] = NOTE_STOP_WORDS,
                min_len: int = 3, null_token: str | None = None) -> Column:
    """B1-B5 as one expression: cleaned tokens of a note, before lemmatising.

    A null note gives an empty token list; ``null_token`` substitutes a text
    for nulls instead (the original tool turned missing notes into "nan").
    """
    src = _col(text)
    src = F.coalesce(src, F.lit(null_token)) if null_token is not None else F.coalesce(src, F.lit(""))
    toks = split_tokens(lower_ascii(letters_only(src)))
    return drop_short(drop_stop_words(toks, stop_words), min_len)


def clean_text(text, stop_words: Iterable[str] = NOTE_STOP_WORDS, min_len: int = 3,
               null_token: str | None = None) -> Column:
    """B8 without lemmas: the cleaned note as one space-separated string."""
    return join_tokens(note_tokens(text, stop_words, min_len, null_token))


def word_tokens(text, stop_words: Iterable[str] | None = None, min_len: int = 2,
                max_len: int = 15) -> Column:
    """Coherence tokeniser.

    Lower-case, runs of letters (any script) or underscore, length within
    [min_len, max_len], stop words removed.
    """
    stops = coherence_stop_words() if stop_words is None else list(stop_words)
    toks = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                F.lit(r"[\p{L}_]+"), F.lit(0))
    toks = F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len))
    return drop_stop_words(toks, stops) if stops else toks


def ngrams(tokens, lo: int = 1, hi: int = 10) -> Column:
    """All word n-grams with lo <= n <= hi, within one token list.

    Returns array<struct<n:int, gram:string>>; explode it to count terms.
    """
    toks = _col(tokens)
    size = F.size(toks)

    def grams_of(n):
        starts = F.sequence(F.lit(1), F.greatest(size - F.lit(n) + 1, F.lit(0)))
        return F.transform(
            F.filter(starts, lambda i: i >= 1),
            lambda i: F.struct(F.lit(n).alias("n"),
                               F.array_join(F.slice(toks, i, F.lit(n)), " ").alias("gram")))

    parts = [F.when(size >= n, grams_of(n)).otherwise(F.array()) for n in range(lo, hi + 1)]
    return F.flatten(F.array(*parts))


def cluster_label(cluster, text, width: int = 80) -> Column:
    """``"Cluster i: <first width chars>..."``."""
    return F.concat(F.lit("Cluster "), _col(cluster).cast("string"), F.lit(": "),
                    F.substring(_col(text), 1, width), F.lit("..."))


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct texts, identified by their first occurrence.

    Returns (query_id, <text_col>) where query_id is the smallest ``id_col``
    carrying the text, so ordering by query_id is first-seen order.  A partial
    (map-side) min followed by one shuffle on the text; no global ordinal is
    needed, which keeps the step free of single-partition windows.
    """
    return df.groupBy(text_col).agg(F.min(id_col).alias("query_id")) \
        .select("query_id", text_col)


# ---------------------------------------------------------------------------
# Lemmatising (B6).  No dictionary ships with Spark, so a lemma is looked up
# in a caller table first, then one noun suffix rule is accepted only if its
# result is itself a word of the vocabulary (the distinct tokens of the
# notes).  The table of changed tokens is computed with joins on Spark.
# ---------------------------------------------------------------------------

def lemma_table(tokens_df: DataFrame, token_col: str = "token",
                lemmas: DataFrame | None = None,
                rules=NOUN_SUFFIX_RULES) -> DataFrame:
    """(token, lemma) for every vocabulary word whose lemma differs from it.

    ``tokens_df`` holds one token per row (exploded notes).  ``lemmas`` is an
    optional (token, lemma) table that wins over the rules.  Among rule
    candidates present in the vocabulary the shortest wins, then rule order.
    """
    vocab = tokens_df.select(F.col(token_col).alias("token")).distinct()
    cands = []
    for order, (suf, rep) in enumerate(rules):
        cands.append(F.when(
            F.col("token").endswith(suf) & (F.length("token") > len(suf)),
            F.struct(F.lit(order).alias("order"),
                     F.concat(F.expr(f"substring(token, 1, length(token) - {len(suf)})"),
                              F.lit(rep)).alias("cand"))))
    exploded = vocab.select("token", F.explode(F.filter(F.array(*cands), lambda c: c.isNotNull())).alias("c")) \
        .select("token", F.col("c.order").alias("order"), F.col("c.cand").alias("cand"))
    hits = exploded.join(vocab.select(F.col("token").alias("cand")), "cand", "left_semi") \
        .filter(F.col("cand") != F.col("token"))
    best = hits.groupBy("token").agg(
        F.min(F.struct(F.length("cand").alias("len"), F.col("order"), F.col("cand"))).alias("b")) \
        .select("token", F.col("b.cand").alias("lemma"))
    best = best.filter(F.length("lemma") <= F.length("token"))
    if lemmas is not None:
        user = lemmas.select(F.col("token"), F.col("lemma").alias("user_lemma"))
        best = best.join(user, "token", "full_outer") \
            .select("token", F.coalesce("user_lemma", "lemma").alias("lemma")) \
            .filter(F.col("lemma") != F.col("token"))
    return best


def lemmatize_tokens(df: DataFrame, id_col: str, tokens_col: str, table: DataFrame,
                     out_col: str = "lemmas", may_change: Column | None = None) -> DataFrame:
    """Apply a (token, lemma) table to an array column, keeping token order.

    Only tokens that may change (``may_change``, a condition on ``token``) leave
    their note: they are looked up by an equi-join, and the changes of a note
    come back as a map from position to lemma that is applied in the row.  All
    in the JVM, the same way at every size.  Returns (id_col, out_col), one row
    per input row; missing token lists give empty lists.
    """
    rows = df.select(id_col, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("_tk")) \
        .withColumn("_h", F.xxhash64("_tk"))
    # rows that agree in id and tokens have the same changes
    ex = rows.select(F.col(id_col).alias("_id"), F.col("_h").alias("_eh"), F.posexplode("_tk").alias("pos", "token"))
    if may_change is not None:
        ex = ex.filter(may_change)
    changed = ex.join(table.select("token", "lemma"), "token").groupBy("_id", "_eh") \
        .agg(F.map_from_entries(F.collect_set(F.struct("pos", "lemma"))).alias("_m"))
    out = rows.join(changed, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_eh")), "left")
    lemma = F.transform("_tk", lambda t, i: F.coalesce(F.try_element_at("_m", i), t))
    return out.select(id_col, F.when(F.col("_m").isNull(), F.col("_tk")).otherwise(lemma).alias(out_col))


def preprocess_notes(df: DataFrame, id_col: str, text_col: str,
                     stop_words: Iterable[str] = NOTE_STOP_WORDS, min_len: int = 3,
                     lemmas: DataFrame | None = None, null_token: str | None = None,
                     lemmatize: bool = True, out_col: str = "clean_text") -> DataFrame:
    """Clean, tokenise, drop stop/short words, lemmatise, re-join.

    Returns (id_col, tokens, out_col).  Without lemmatising the whole pipeline
    is one projection; lemmatising adds a vocabulary pass and two joins.
    """
    base = df.select(id_col, note_tokens(text_col, stop_words, min_len, null_token).alias("tokens"))
    if not lemmatize:
        return base.withColumn(out_col, join_tokens("tokens"))
    flat = base.select(F.explode("tokens").alias("token"))
    table = lemma_table(flat, "token", lemmas)
    by_rule = reduce(or_, [F.col("token").endswith(suffix) for suffix, _ in NOUN_SUFFIX_RULES])
    out = lemmatize_tokens(base, id_col, "tokens", table, "lemmas", by_rule if lemmas is None else None)
    return out.select(id_col, F.col("lemmas").alias("tokens"), join_tokens("lemmas").alias(out_col))
