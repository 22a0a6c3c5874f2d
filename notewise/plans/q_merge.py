"""Merge, encoding, fold and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewise.functions.vectors import r4
from notewise.operators import cv
from notewise.operators.encode import interaction_code, label_encode, levels, one_hot
from notewise.operators.merge import visit_intervals
from notewise.operators.models import baselines
from notewise.plans.fixtures import DRUG_EVENTS, FIXED_K, modelling_table, search_wide, visits
from notewise.plans.q_search import _VECS
from notewise.plans.registry import R4, query
from notewise.sources.tables import load

_WIDE_COLS = [c for r in range(1, 6) for c in (f"top{r}_matched_sentence", f"top{r}_similarity_score")]


def _wide_sql() -> str:
    sel = ", ".join(f"max(CASE WHEN rnk = {r} THEN sent END) AS top{r}_matched_sentence, "
                    f"max(CASE WHEN rnk = {r} THEN sc END) AS top{r}_similarity_score" for r in range(1, 6))
    return f"""{_VECS},
rr AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY score DESC, corpus_id) AS rnk FROM s),
top AS (SELECT rr.query_index, rr.rnk, b.text AS sent, {R4('rr.score')} AS sc
        FROM rr LEFT JOIN benchmark b ON b.item_id = rr.corpus_id WHERE rr.rnk <= 5),
wide AS (SELECT query_index, {sel} FROM top GROUP BY query_index)"""


_VIS = f"""nq AS (SELECT count(*) AS nq FROM documents),
vis AS (SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS participant_id, 'V' || CAST(event_id AS VARCHAR) AS visit_code,
               CAST(ts AS DATE) AS visit_date, event_id % nq.nq AS query_index
        FROM events CROSS JOIN nq WHERE event_type = 'purchase'),
chunks(chunk, d0, d1) AS (VALUES ('before', -7, 0), ('after1', 0, 7), ('after2', 7, 14)),
iv AS (SELECT vis.*, chunks.chunk, vis.visit_date + chunks.d0 AS start_date, vis.visit_date + (chunks.d1 - 1) AS end_date
       FROM vis CROSS JOIN chunks)"""


def _adh_sql() -> str:
    parts = []
    for drug, ev in DRUG_EVENTS.items():
        parts.append(f"""SELECT iv.row_id, iv.chunk, '{drug}' AS drug, count(dd.day) AS dose_days
   FROM iv LEFT JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS participant_id, CAST(ts AS DATE) AS day
                      FROM events WHERE event_type = '{ev}') dd
     ON dd.participant_id = iv.participant_id AND dd.day BETWEEN iv.start_date AND iv.end_date
   GROUP BY ALL""")
    return "adh AS (" + "\nUNION ALL ".join(parts) + ")"


MT_SQL = f"""{_wide_sql()},
{_VIS},
{_adh_sql()},
mt AS (SELECT iv.participant_id, iv.visit_code, iv.visit_date, iv.row_id, iv.query_index,
              CAST(iv.query_index % {FIXED_K} AS BIGINT) AS cluster, {', '.join('wide.' + c for c in _WIDE_COLS)},
              iv.chunk, CAST(adh.dose_days AS BIGINT) AS dose_days,
              adh.dose_days / CAST(date_diff('day', iv.start_date, iv.end_date) + 1 AS DOUBLE) AS adherence,
              iv.start_date, iv.end_date, adh.drug
       FROM iv JOIN adh ON adh.row_id = iv.row_id AND adh.chunk = iv.chunk
               JOIN wide ON wide.query_index = iv.query_index)"""

_MT_COLS = ["participant_id", "visit_code", "visit_date", "row_id", "query_index", "cluster", *_WIDE_COLS,
            "chunk", "dose_days", "adherence", "start_date", "end_date", "drug"]


def _mt_out(prefix: str = "") -> str:
    return ", ".join(f"{R4(prefix + c)} AS {c}" if c == "adherence" else prefix + c for c in _MT_COLS)


@query("search_wide", f"""
WITH {_wide_sql()}
SELECT query_index, {', '.join(_WIDE_COLS)} FROM wide
""")
def search_wide_q(spark, sf_dir):
    """F1: top-5 ranks pivoted to top{r}_matched_sentence / top{r}_similarity_score."""
    return search_wide(spark, sf_dir)


@query("visit_intervals", f"""
WITH {_VIS}
SELECT row_id, participant_id, visit_code, visit_date, query_index, chunk, start_date, end_date FROM iv
""")
def visit_intervals_q(spark, sf_dir):
    """visits with their three chunk intervals."""
    iv = visit_intervals(visits(spark, sf_dir))
    return iv.select("row_id", "participant_id", "visit_code", "visit_date", "query_index", "chunk",
                     "start_date", "end_date")


@query("modelling_table", f"""
WITH {MT_SQL}
SELECT {_mt_out()} FROM mt
""")
def modelling_table_q(spark, sf_dir):
    """The modelling table of both medications (interval adherence included)."""
    mt = modelling_table(spark, sf_dir)
    return mt.select(*[r4(c).alias(c) if c == "adherence" else F.col(c) for c in _MT_COLS])


def _recursive_folds_sql(src: str, gid: str, tag: str = "") -> str:
    """CTEs ending in ``folds(gid, fold)``; names carry ``tag``."""
    return f"""g{tag} AS (SELECT {gid} AS gid, count(*) AS n FROM {src} GROUP BY 1),
o{tag} AS (SELECT gid, n, row_number() OVER (ORDER BY n DESC, gid DESC) AS r FROM g{tag}),
rec{tag}(r, gid, fold, loads) AS (
  SELECT o.r, o.gid, 1, [o.n, 0, 0, 0, 0]::BIGINT[] FROM o{tag} o WHERE o.r = 1
  UNION ALL
  SELECT o.r, o.gid, list_position(rec.loads, list_min(rec.loads)),
         list_transform(rec.loads, lambda x, i: CASE WHEN i = list_position(rec.loads, list_min(rec.loads)) THEN x + o.n ELSE x END)
  FROM rec{tag} rec JOIN o{tag} o ON o.r = rec.r + 1),
folds{tag} AS (SELECT gid, CAST(fold AS BIGINT) AS fold FROM rec{tag})"""


def _drug_folds_sql() -> str:
    """CTEs ending in ``folds(drug, gid, fold)``: each medication's participants on its own rows."""
    each = [_recursive_folds_sql(f"(SELECT * FROM mt WHERE drug = '{d}')", "participant_id", f"_{d}") for d in DRUG_EVENTS]
    union = " UNION ALL ".join(f"SELECT '{d}' AS drug, gid, fold FROM folds_{d}" for d in DRUG_EVENTS)
    return ",\n".join([*each, f"folds AS ({union})"])


@query("group_folds", f"""
WITH RECURSIVE {MT_SQL},
{_drug_folds_sql()}
SELECT drug, gid AS participant_id, fold FROM folds
""")
def group_folds_q(spark, sf_dir):
    """5 group folds of each medication's participants (whole participants, greedy balance)."""
    mt = modelling_table(spark, sf_dir).persist()
    return cv.with_folds(mt, "participant_id", 5, by="drug").select("drug", "participant_id", "fold").distinct()


@query("group_folds_orders", f"""
WITH RECURSIVE {_recursive_folds_sql('orders', 'o_custkey')}
SELECT gid AS o_custkey, fold FROM folds
""")
def group_folds_orders_q(spark, sf_dir):
    """H1 on many small groups: customers of ``orders`` (1-25 rows each)."""
    return cv.group_kfold(load(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 5)


@query("fold_counts", f"""
WITH RECURSIVE {MT_SQL},
{_drug_folds_sql()},
j AS (SELECT mt.*, folds.fold FROM mt JOIN folds ON folds.gid = mt.participant_id AND folds.drug = mt.drug),
per AS (SELECT drug, fold, count(DISTINCT participant_id) AS tp, count(*) AS ts FROM j GROUP BY drug, fold)
SELECT drug, fold, CAST(sum(tp) OVER (PARTITION BY drug) - tp AS BIGINT) AS n_train_participants,
       CAST(tp AS BIGINT) AS n_test_participants, CAST(sum(ts) OVER (PARTITION BY drug) - ts AS BIGINT) AS n_train_samples,
       CAST(ts AS BIGINT) AS n_test_samples FROM per
""")
def fold_counts_q(spark, sf_dir):
    """H2/H3: participants and rows on each side of every fold, per medication."""
    return cv.fold_counts(_with_folds(spark, sf_dir), "participant_id", by="drug")


@query("encoded_features", f"""
WITH {MT_SQL},
lv AS (SELECT list(DISTINCT chunk ORDER BY chunk) AS chunks, list(DISTINCT participant_id ORDER BY participant_id) AS parts,
              list(DISTINCT cluster ORDER BY cluster) AS cls FROM mt)
SELECT drug, row_id, chunk, CAST(list_position(lv.chunks, chunk) - 1 AS BIGINT) AS chunk_code,
       CAST(list_position(lv.parts, participant_id) - 1 AS BIGINT) AS participant_code,
       {', '.join(f"CASE WHEN cluster = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cluster_{c}" for c in range(FIXED_K))}
FROM mt CROSS JOIN lv
""")
def encoded_features_q(spark, sf_dir):
    """Label codes of chunk and participant (sorted levels), one-hot clusters."""
    mt = modelling_table(spark, sf_dir).persist()
    mt = label_encode(mt, "chunk", "chunk_code")
    mt = label_encode(mt, "participant_id", "participant_code")
    mt, names = one_hot(mt, "cluster", "cluster", levels(mt, "cluster"))
    return mt.select("drug", "row_id", "chunk", "chunk_code", "participant_code", *names)


@query("interaction_design", f"""
WITH {MT_SQL}
SELECT drug, row_id,
  {', '.join(f"CASE WHEN chunk = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"C(Chunk)[T.{c}]\"" for c in ['after2', 'before'])},
  {', '.join(f"CASE WHEN cluster = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"C(Cluster)[T.{k}]\"" for k in range(1, FIXED_K))},
  {', '.join(f"CASE WHEN chunk = '{c}' AND cluster = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"C(Chunk)[T.{c}]:C(Cluster)[T.{k}]\"" for c in ['after2', 'before'] for k in range(1, FIXED_K))}
FROM mt
""")
def interaction_design_q(spark, sf_dir):
    """Treatment-coded chunk and cluster with all chunk x cluster products."""
    mt = modelling_table(spark, sf_dir)
    mt, names = interaction_code(mt, "chunk", "cluster", "C(Chunk)", "C(Cluster)")
    return mt.select("drug", "row_id", *[F.col(f"`{n}`") for n in names])


def _baseline_sql() -> str:
    return f"""{MT_SQL},
{_drug_folds_sql()},
j AS (SELECT mt.*, folds.fold FROM mt JOIN folds ON folds.gid = mt.participant_id AND folds.drug = mt.drug),
fl AS (SELECT DISTINCT fold FROM folds),
tr AS (SELECT d.drug, fl.fold, avg(j.adherence) AS mean_pred, median(j.adherence) AS median_pred
       FROM (SELECT DISTINCT drug FROM mt) d CROSS JOIN fl JOIN j ON j.drug = d.drug AND j.fold <> fl.fold GROUP BY ALL),
preds AS (SELECT j.drug, 'Mean_Baseline' AS model, j.fold, j.adherence AS y, tr.mean_pred AS p FROM j JOIN tr USING (drug, fold)
          UNION ALL SELECT j.drug, 'Median_Baseline', j.fold, j.adherence, tr.median_pred FROM j JOIN tr USING (drug, fold)),
fm AS (SELECT drug, model, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM preds GROUP BY ALL)"""


@query("baseline_folds", f"""
WITH RECURSIVE {_baseline_sql()}
SELECT drug, model, fold, {R4('mae')} AS mae, {R4('rmse')} AS rmse FROM fm
""")
def baseline_folds_q(spark, sf_dir):
    """I1/I2 + H4-H6: mean and median baselines, MAE and RMSE per fold and medication."""
    fm = baselines(_with_folds(spark, sf_dir), "adherence", "drug")
    return fm.select("drug", "model", "fold", r4("mae").alias("mae"), r4("rmse").alias("rmse"))


@query("baseline_comparison", f"""
WITH RECURSIVE {_baseline_sql()}
SELECT drug AS Drug, model AS Model, {R4('avg(mae)')} AS MAE_mean, {R4('stddev_pop(mae)')} AS MAE_std,
       {R4('avg(rmse)')} AS RMSE_mean, {R4('stddev_pop(rmse)')} AS RMSE_std, 'Baseline' AS Model_Type
FROM fm GROUP BY drug, model
""")
def baseline_comparison_q(spark, sf_dir):
    """Mean and population std over folds, per medication and baseline."""
    fm = baselines(_with_folds(spark, sf_dir), "adherence", "drug")
    s = cv.summarise_folds(fm, cols=("mae", "rmse"), by=["drug", "model"])
    return s.select(F.col("drug").alias("Drug"), F.col("model").alias("Model"),
                    *[r4(c).alias(c) for c in ("MAE_mean", "MAE_std", "RMSE_mean", "RMSE_std")],
                    F.lit("Baseline").alias("Model_Type"))


def _with_folds(spark, sf_dir):
    """What baselines and the one-feature ridge read of both medications' rows, each with folds of its own participants."""
    mt = modelling_table(spark, sf_dir, texts=False, only=["participant_id", "top1_similarity_score"]).persist()
    return cv.with_folds(mt, "participant_id", 5, by="drug").persist()


_FLAT = [f"sim_{r}" for r in range(1, 6)] + ["chunk_encoded"] + [f"cluster_{c}" for c in range(FIXED_K)]


@query("standardise_stats", f"""
WITH RECURSIVE {MT_SQL},
{_drug_folds_sql()},
lv AS (SELECT list(DISTINCT chunk ORDER BY chunk) AS chunks FROM mt),
feat AS (SELECT mt.drug, folds.fold,
                {', '.join(f'mt.top{r}_similarity_score AS sim_{r}' for r in range(1, 6))},
                CAST(list_position(lv.chunks, mt.chunk) - 1 AS DOUBLE) AS chunk_encoded,
                {', '.join(f'CASE WHEN mt.cluster = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cluster_{c}' for c in range(FIXED_K))}
         FROM mt JOIN folds ON folds.gid = mt.participant_id AND folds.drug = mt.drug CROSS JOIN lv),
lng AS (UNPIVOT feat ON {', '.join(_FLAT)} INTO NAME feature VALUE x),
fl AS (SELECT DISTINCT fold AS train_fold FROM folds)
SELECT lng.drug, fl.train_fold AS fold, lng.feature, {R4('avg(lng.x)')} AS mean, {R4('stddev_pop(lng.x)')} AS std
FROM lng JOIN fl ON lng.fold <> fl.train_fold GROUP BY lng.drug, fl.train_fold, lng.feature
""")
def standardise_stats_q(spark, sf_dir):
    """Training-fold mean and population std of every ridge feature (per medication)."""
    from notewise.operators.models import gram_by
    from notewise.plans.fixtures import model_frame

    mt, names = model_frame(spark, sf_dir)
    feats = names["flat"]
    g = gram_by(mt, feats, "adherence", ["drug", "fold"])
    rows = []
    for drug in sorted({k[0] for k in g}):
        parts = {k[1]: v for k, v in g.items() if k[0] == drug}
        total = {key: sum(v[key] for v in parts.values()) for key in ("n", "sx", "sxx")}
        for f, v in parts.items():
            n = total["n"] - v["n"]
            mu = (total["sx"] - v["sx"]) / n
            var = (total["sxx"] - v["sxx"]).diagonal() / n - mu * mu
            for j, name in enumerate(feats):
                rows.append((drug, int(f), name, float(mu[j]), float(max(var[j], 0.0) ** 0.5)))
    df = spark.createDataFrame(rows, "drug string, fold bigint, feature string, mean double, std double")
    return df.select("drug", "fold", "feature", r4("mean").alias("mean"), r4("std").alias("std"))


@query("ridge_one_feature", f"""
WITH RECURSIVE {MT_SQL},
{_drug_folds_sql()},
j AS (SELECT mt.drug, folds.fold, mt.top1_similarity_score AS x, mt.adherence AS y
      FROM mt JOIN folds ON folds.gid = mt.participant_id AND folds.drug = mt.drug),
fl AS (SELECT DISTINCT fold AS train_fold FROM folds),
tr0 AS (SELECT j.drug, fl.train_fold AS fold, count(*) AS n, avg(j.x) AS mx, avg(j.y) AS my,
               stddev_pop(j.x) AS sx, sum(j.x * j.y) AS sxy
        FROM j JOIN fl ON j.fold <> fl.train_fold GROUP BY ALL),
tr AS (SELECT drug, fold, mx, my,
              CASE WHEN sx = 0 THEN 0.0 ELSE ((sxy - n * mx * my) / sx) / (n + 1.0) / sx END AS w FROM tr0),
pr AS (SELECT j.drug, j.fold, j.y, greatest(0.0, least(1.0, tr.my + (j.x - tr.mx) * tr.w)) AS p
       FROM j JOIN tr USING (drug, fold)),
ym AS (SELECT drug, fold, avg(y) AS ybar FROM pr GROUP BY ALL)
SELECT pr.drug, pr.fold, {R4('avg(abs(pr.y - pr.p))')} AS mae, {R4('sqrt(avg((pr.y - pr.p) * (pr.y - pr.p)))')} AS rmse,
       {R4('1 - sum((pr.y - pr.p) * (pr.y - pr.p)) / sum((pr.y - ym.ybar) * (pr.y - ym.ybar))')} AS r2,
       'Ridge_Regression' AS model
FROM pr JOIN ym USING (drug, fold) GROUP BY pr.drug, pr.fold
""")
def ridge_one_feature_q(spark, sf_dir):
    """I3 with one feature (top-1 score): the ridge path checked end to end in SQL."""
    from notewise.operators.models import ridge_cv

    mt = _with_folds(spark, sf_dir).withColumnRenamed("top1_similarity_score", "sim_1")
    m = ridge_cv(mt, "adherence", ["sim_1"], by="drug")
    return m.select("drug", "fold", *[r4(c).alias(c) for c in ("mae", "rmse", "r2")], "model")


@query("baseline_ridge_ranking", f"""
WITH RECURSIVE {_baseline_sql()},
tr0 AS (SELECT j.drug, fl.fold, count(*) AS n, avg(j.top1_similarity_score) AS mx, avg(j.adherence) AS my,
               stddev_pop(j.top1_similarity_score) AS sx, sum(j.top1_similarity_score * j.adherence) AS sxy
        FROM j JOIN fl ON j.fold <> fl.fold GROUP BY ALL),
rp AS (SELECT j.drug, j.fold, j.adherence AS y, greatest(0.0, least(1.0, my + (j.top1_similarity_score - mx)
         * CASE WHEN sx = 0 THEN 0.0 ELSE ((sxy - n * mx * my) / sx) / (n + 1.0) / sx END)) AS p
       FROM j JOIN tr0 USING (drug, fold)),
every AS (SELECT drug, model, fold, mae, rmse FROM fm
          UNION ALL SELECT drug, 'Ridge_Regression', fold, avg(abs(y - p)), sqrt(avg((y - p) * (y - p))) FROM rp GROUP BY drug, fold),
total AS (SELECT drug, model, avg(mae) AS mae, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse, stddev_pop(rmse) AS rmse_std
          FROM every GROUP BY drug, model)
SELECT drug AS Drug, model AS Model, {R4('mae')} AS MAE_mean, {R4('mae_std')} AS MAE_std, {R4('rmse')} AS RMSE_mean,
       {R4('rmse_std')} AS RMSE_std, CASE WHEN model = 'Ridge_Regression' THEN 'Linear' ELSE 'Baseline' END AS Model_Type,
       row_number() OVER (PARTITION BY drug ORDER BY mae, model) AS position FROM total
""")
def baseline_ridge_ranking_q(spark, sf_dir):
    """The comparison, best MAE first, of the baselines and the one-feature ridge, both medications."""
    from notewise.operators.compare import compare_models
    from notewise.operators.models import ridge_cv

    mt = _with_folds(spark, sf_dir).withColumnRenamed("top1_similarity_score", "sim_1")
    s = compare_models({"baselines": ("Baseline", lambda: baselines(mt, "adherence", "drug")),
                        "ridge": ("Linear", lambda: ridge_cv(mt, "adherence", ["sim_1"], by="drug"))})
    return s.select(F.col("drug").alias("Drug"), F.col("model").alias("Model"),
                    *[r4(c).alias(c) for c in ("MAE_mean", "MAE_std", "RMSE_mean", "RMSE_std")], "Model_Type", "position")
