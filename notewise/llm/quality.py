"""Quality classifier with hierarchical empirical Bayes.

A logistic model over byte-class features gives every document a probability and
thereby evidence: its log odds against the base rate.  Documents are then grouped
by host and by path below it.  A host's good rate is shrunk to the global rate, a
path's to its host, each as a beta-binomial posterior whose prior strength is
estimated from the spread between groups (method of moments).  The result adds a
document's evidence to the log odds of its path's posterior, from which the
document itself is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.common import put
from notewise.llm.language_id import held_out
from notewise.llm.tokens import SEPARATOR, buffers, runs

#: Bound of the sample that the logistic model is fitted on.
SAMPLE_ROWS = 20_000
#: Documents below this probability are not kept.
THRESHOLD = 0.5
FEATURES = ["log_bytes", "space", "letter", "upper", "digit", "mark", "high", "word_bytes", "line"]
_CLIP = 1e-6


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    upper, lower = (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
    digit, high = (code >= 48) & (code <= 57), code >= 128
    return {"space": SEPARATOR, "letter": upper | lower, "upper": upper, "digit": digit,
            "mark": (code > 32) & (code < 127) & ~(upper | lower | digit), "high": high, "line": code == 10}


_CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text: shares of byte classes, bytes per word, log of bytes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(size)
    if not len(data):
        return out
    full = np.flatnonzero(size)

    def per_row(flags):
        got = np.zeros(n)
        got[full] = np.add.reduceat(flags, offsets[:-1][full], dtype=np.int64)
        return got

    share = {name: per_row(table[data]) / np.maximum(size, 1) for name, table in _CLASSES.items()}
    solid = ~SEPARATOR[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    starts[offsets[:-1][full]] = solid[offsets[:-1][full]]
    share["word_bytes"] = per_row(solid) / np.maximum(per_row(starts), 1) / 10
    for i, name in enumerate(FEATURES[1:], 1):
        out[:, i] = share[name]
    return out


def _featurise(batches):
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        parts = [features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in runs(offsets)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        flat = pa.array(x.reshape(-1), pa.float64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists],
                                         names=["doc_id", "host", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50):
    """Weights of a ridge logistic model on standardised features: (mean, scale, weights)."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    z = np.column_stack([z, z[:, 1:] ** 2])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _logit(p):
    p = F.greatest(F.lit(_CLIP), F.least(F.lit(1 - _CLIP), p))
    return F.log(p / (1 - p))


def prior_strength(groups: int, rows: float, squares: float, spread: float) -> float:
    """Strength a + b of a beta prior, by moments.

    ``spread`` is the sum over groups of n * (rate - mean)^2 / (mean * (1 - mean)),
    ``squares`` that of n^2.  Groups that vary no more than chance give a strong prior.
    """
    slack = rows - squares / max(rows, 1e-12) - (groups - 1)
    rho = (spread - (groups - 1)) / slack if slack > 0 else 0.0
    rho = min(max(rho, 1e-6), 0.999)
    return 1 / rho - 1


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
            threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, doc_prob, host_prob, path_prob, quality_prob, kept.

    Labels of held-out documents (:func:`held_out`) are never used.  A labelled
    training document counts in its groups with its label, any other with its
    ``doc_prob``, so groups use all documents.  Null hosts and paths are groups of
    their own.  Of several labels of an id the largest counts.  Without labels
    every ``doc_prob`` is 0.5.  The logistic model is fitted on at most
    ``sample_rows`` labelled rows (smallest hash of the id).
    """
    rows = put(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                           F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
               .mapInArrow(_featurise, "doc_id long, host string, path string, x array<double>"), "features")
    truth = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)) \
        .groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = rows.join(truth, rows["doc_id"] == truth["l_id"], "left").drop("l_id")
    sample = rows.filter("y IS NOT NULL").select("x", "y", F.xxhash64("doc_id").alias("h")) \
        .orderBy("h", "y", "x").limit(sample_rows).collect()
    if sample:
        x, y = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float)
        mean, scale, w = fit_logistic(x, y)
        z = [(F.element_at("x", i + 1) - float(mean[i])) / float(scale[i]) for i in range(len(FEATURES))]
        score = F.lit(float(w[0]))
        for i, zi in enumerate(z):
            score = score + zi * float(w[1 + i]) + zi * zi * float(w[1 + len(z) + i])
        score = F.greatest(F.lit(-13.0), F.least(F.lit(13.0), score))
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    else:
        score, base = F.lit(0.0), 0.5
    scored = put(rows.withColumn("doc_prob", 1 / (1 + F.exp(-score)))
                 .select("doc_id", "host", "path", "doc_prob", F.coalesce("y", "doc_prob").alias("q")), "scored")

    paths = scored.groupBy("host", "path").agg(F.sum("q").alias("k"), F.count("*").cast("double").alias("n"))
    paths = put(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    top = hosts.agg(F.sum("hk").alias("k"), F.sum("hn").alias("n"), F.count("*").alias("g"),
                    F.sum(F.col("hn") * F.col("hn")).alias("s")).first()
    rate = min(max((top["k"] or 0.0) / top["n"], _CLIP), 1 - _CLIP) if top["n"] else 0.5
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hk") / F.col("hn") - rate, F.lit(2)))).first()[0] or 0.0
    strength = prior_strength(top["g"], top["n"] or 0.0, top["s"] or 0.0, spread / (rate * (1 - rate)))
    hosts = hosts.withColumn("host_prob", (F.col("hk") + strength * rate) / (F.col("hn") + strength)) \
        .withColumnRenamed("host", "h_")
    below = paths.join(hosts, paths["host"].eqNullSafe(hosts["h_"])).drop("h_")
    m = F.greatest(F.lit(_CLIP), F.least(F.lit(1 - _CLIP), F.col("host_prob")))
    low = below.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"),
                    F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, F.lit(2)) / (m * (1 - m))).alias("d")).first()
    inner = prior_strength(low["g"], low["n"] or 0.0, low["s"] or 0.0, low["d"] or 0.0)
    below = below.select(F.col("host").alias("h_"), F.col("path").alias("p_"), "k", "n", "hk", "hn")
    joined = scored.join(below, scored["host"].eqNullSafe(below["h_"]) & scored["path"].eqNullSafe(below["p_"]))
    host_prob = (F.col("hk") - F.col("q") + strength * rate) / (F.col("hn") - 1 + strength)
    path_prob = (F.col("k") - F.col("q") + inner * F.col("host_prob")) / (F.col("n") - 1 + inner)
    final = 1 / (1 + F.exp(-(_logit(F.col("path_prob")) + _logit(F.col("doc_prob"))
                             - float(np.log(base / (1 - base))))))
    return joined.withColumn("host_prob", host_prob).withColumn("path_prob", path_prob) \
        .withColumn("quality_prob", final).select(
            "doc_id", held_out("doc_id").alias("held_out"), "doc_prob", "host_prob", "path_prob", "quality_prob",
            (F.col("quality_prob") >= threshold).alias("kept"))
