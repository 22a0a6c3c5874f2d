"""Roles the driver's test tables play (see FIXTURES.md).

* notes: every row of ``documents``; theme corpus: every row of ``benchmark``.
* vectors: hashed TF-IDF of the cleaned texts of both.
* fixed clusters: ``doc_id % FIXED_K``.
* participants / visits / dosing days: ``events`` (purchase = visit, click =
  ART dose day, view = BDQ dose day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.functions.text import note_tokens
from notewise.operators.search import hash_idf, hash_vectors
from notewise.sources.tables import load


def search_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(notes (query_id, embedding, note), corpus (item_id, embedding, text)): all documents, all of ``benchmark``."""
    docs = load(spark, sf_dir, "documents", spread_by="doc_id")
    notes = docs.select(F.col("doc_id").alias("query_id"), note_tokens("text").alias("tokens"), F.col("text").alias("note"))
    bench = load(spark, sf_dir, "benchmark").select("item_id", note_tokens("text").alias("tokens"), "text")
    idf = hash_idf([notes, bench])
    return (hash_vectors(notes, "query_id", "tokens", idf),
            hash_vectors(bench, "item_id", "tokens", idf).join(bench.select("item_id", "text"), "item_id"))


# Which event types play the visits and the dosing days of the
# two medications.
VISIT_EVENT = "purchase"
DRUG_EVENTS = {"ART": "click", "BDQ": "view"}
FIXED_K = 6


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, participant_id, visit_code, visit_date, query_index).

    Each visit takes the note ``event_id % (number of documents)``.
    """
    n_notes = load(spark, sf_dir, "documents").count()
    ev = load(spark, sf_dir, "events").filter(F.col("event_type") == VISIT_EVENT)
    return ev.select(F.col("event_id").alias("row_id"),
                     F.col("user_id").cast("string").alias("participant_id"),
                     F.concat(F.lit("V"), F.col("event_id").cast("string")).alias("visit_code"),
                     F.to_date("ts").alias("visit_date"),
                     (F.col("event_id") % F.lit(n_notes)).alias("query_index"))


def doses(spark: SparkSession, sf_dir: str, drug: str) -> DataFrame:
    from notewise.operators.merge import dose_days

    ev = load(spark, sf_dir, "events").filter(F.col("event_type") == DRUG_EVENTS[drug]) \
        .withColumn("participant_id", F.col("user_id").cast("string"))
    return dose_days(ev, "participant_id", "ts")


def search_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewise.operators.merge import ranks_to_wide
    from notewise.operators.search import semantic_search

    notes, corpus = search_frames(spark, sf_dir)
    res = semantic_search(notes, corpus, "query_id", "embedding", "item_id", "embedding", corpus_text="text", k=5, digits=4)
    return ranks_to_wide(res, "query_index", 5)


def modelling_table(spark: SparkSession, sf_dir: str, drugs=("ART", "BDQ"), texts: bool = True,
                    only: list[str] | None = None) -> DataFrame:
    """one row per (visit, chunk, drug) with features and the outcome.

    Without ``texts`` the matched sentences are left out: five texts a row are most of what the joins move.
    ``only`` names the columns that are kept, beside the outcome: a visit is kept with what it needs for both.
    """
    from notewise.operators.merge import attach_cluster, interval_adherence, visit_intervals

    v = visits(spark, sf_dir)
    clusters = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_index"),
                                                       (F.col("doc_id") % FIXED_K).cast("bigint").alias("cluster"))
    wide = search_wide(spark, sf_dir)
    if not texts:
        wide = wide.drop(*[c for c in wide.columns if c.endswith("_matched_sentence")])
    base = attach_cluster(v.join(wide, "query_index"), clusters, on="query_index")
    if only is not None:
        need = {"row_id", "participant_id", "visit_date", *only}
        base = base.select(*[c for c in base.columns if c in need])
    iv = visit_intervals(base).persist()
    out = None
    for drug in drugs:
        a = interval_adherence(iv, doses(spark, sf_dir, drug)).withColumn("drug", F.lit(drug))
        if only is not None:
            a = a.select(*only, "adherence", "drug")
        out = a if out is None else out.unionByName(a)
    return out


SIM_COLS = [f"sim_{r}" for r in range(1, 6)]


def model_frame(spark: SparkSession, sf_dir: str, drugs=("ART", "BDQ")) -> tuple[DataFrame, dict]:
    """Modelling table + features + participant folds.

    Returns (frame, names) where names lists the feature columns of each
    model family: 'flat' = 5 sims + chunk code + cluster one-hot (ridge,
    forest, GAM); 'lme' = intercept, 5 sims, chunk and cluster treatment
    dummies; 'lme_linear' = the same with the chunk code as a number (the comparison's formula).
    Every medication has its own folds.
    """
    from notewise.operators.cv import with_folds
    from notewise.operators.encode import label_encode, levels, one_hot, select_features, treatment_code

    mt = modelling_table(spark, sf_dir, drugs, texts=False).persist()
    mt = select_features(mt, {f"top{r}_similarity_score": f"sim_{r}" for r in range(1, 6)})
    mt = label_encode(mt, "chunk", "chunk_encoded")
    cl = levels(mt, "cluster")
    mt, onehot = one_hot(mt, "cluster", "cluster", cl)
    mt, chunk_t = treatment_code(mt.withColumn("chunk_code_s", F.col("chunk_encoded").cast("string")),
                                 "chunk_code_s", "C(chunk_encoded)")
    mt, clus_t = treatment_code(mt, "cluster", "C(Cluster)", cl)
    mt = mt.withColumn("Intercept", F.lit(1.0))
    mt = with_folds(mt, "participant_id", 5, by="drug").persist()
    names = {"flat": SIM_COLS + ["chunk_encoded"] + onehot,
             "lme": ["Intercept"] + SIM_COLS + chunk_t + clus_t,
             "lme_linear": ["Intercept"] + SIM_COLS + ["chunk_encoded"] + clus_t}
    return mt, names
