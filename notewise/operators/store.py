"""Fitted parameters as one table format.

A model is a set of named numeric arrays (centres, weights, knots, means) and a
few settings.  Each is one row: (kind, name, shape, values, setting); the table
is Parquet, so it can be read by any engine and by a later session.
Parameters are bounded by the model, never by the rows it was fitted on.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from notewise.operators.clustering import assign
from notewise.operators.cv import clip01
from notewise.operators.models import LMEModel, _predict_col

SCHEMA = "kind string, name string, shape array<int>, values array<double>, setting string"


def save_params(spark: SparkSession, path: str, kind: str, arrays: Mapping[str, np.ndarray],
                settings: Mapping | None = None) -> None:
    """Write a model's arrays and (JSON) settings."""
    rows = [(kind, name, [int(n) for n in np.shape(a)], [float(x) for x in np.ravel(np.asarray(a, dtype=np.float64))], None)
            for name, a in arrays.items()]
    rows.append((kind, "settings", None, None, json.dumps(dict(settings or {}))))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, settings) of a saved model; another kind of model raises."""
    rows = spark.read.schema(SCHEMA).parquet(path).collect()
    if {r["kind"] for r in rows} != {kind}:
        raise ValueError(f"{path} holds {sorted({r['kind'] for r in rows})}, not {kind}")
    arrays = {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in rows if r["shape"] is not None}
    return arrays, json.loads(next(r["setting"] for r in rows if r["name"] == "settings"))


def save_kmeans(spark: SparkSession, path: str, centres: np.ndarray, vec: str) -> None:
    save_params(spark, path, "kmeans", {"centres": centres}, {"vec": vec})


def kmeans_labels(df: DataFrame, path: str, id_col: str) -> DataFrame:
    """(id, cluster, dist2) of rows under saved centres."""
    arrays, settings = load_params(df.sparkSession, path, "kmeans")
    return assign(df, id_col, settings["vec"], arrays["centres"])


def save_linear(spark: SparkSession, path: str, intercept: float, weights: np.ndarray, features: list[str]) -> None:
    """A ridge (or any linear) model in original units."""
    save_params(spark, path, "linear", {"intercept": np.array([intercept]), "weights": weights}, {"features": list(features)})


def linear_predictions(df: DataFrame, path: str, out: str = "predicted", clip: bool = True) -> DataFrame:
    from pyspark.sql import functions as F

    arrays, settings = load_params(df.sparkSession, path, "linear")
    w = F.array(*[F.lit(float(x)) for x in arrays["weights"]])
    row = df.withColumn("_w", w).withColumn("_b", F.lit(float(arrays["intercept"][0])))
    pred = _predict_col(settings["features"])
    return row.withColumn(out, clip01(pred) if clip else pred).drop("_w", "_b")


def save_lme(spark: SparkSession, path: str, model: LMEModel) -> None:
    f = model.fit
    save_params(spark, path, "lme", {"beta": f["beta"], "se": f["se"], "theta": np.array([f["theta"]]),
                                     "sigma2": np.array([f["sigma2"]])},
                {"fixed": model.fixed, "names": model.names, "group": model.group_col, "y": model.y,
                 "dropped": f.get("dropped", [])})


def load_lme(spark: SparkSession, path: str) -> LMEModel:
    a, s = load_params(spark, path, "lme")
    theta, sigma2 = float(a["theta"][0]), float(a["sigma2"][0])
    fit = {"beta": a["beta"], "se": a["se"], "theta": theta, "sigma2": sigma2, "group_var": theta * sigma2,
           "dropped": s["dropped"]}
    return LMEModel(fit, s["fixed"], s["group"], s["y"], s["names"])
