"""Regression models under grouped CV.

Every model here reduces to sums that Spark computes in one pass per fold
(or per group) and a small solve on the driver: the driver never sees rows,
only p x p matrices, per-fold constants and per-group-size summaries.  The
forest uses MLlib; external models run per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewise.operators.cv import clip01, regression_metrics


def _fold_values(df: DataFrame, fold_col: str) -> list[int]:
    return sorted(int(r[0]) for r in df.select(fold_col).distinct().collect())


def training_medians(df: DataFrame, y: str, keys: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """(keys, fold, median_pred): exact median of ``y`` over all rows outside each fold.

    Rows are first counted by value and fold, so a training set is total minus
    fold on counts and no row is copied.  The values are range-partitioned and
    summed up in pieces; a row per piece and key carries the counts on, so the
    distinct values of a key need not fit in one task.
    """
    from notewise.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    folds = _fold_values(df, fold_col)
    inside = [F.count(F.when(F.col(fold_col) == f, 1)) for f in folds]
    counts = df.filter(F.col(y).isNotNull()).groupBy(*keys, F.col(y).cast("double").alias("_v")) \
        .agg(*[(F.count(F.lit(1)) - n).alias(f"_t{i}") for i, n in enumerate(inside)])
    order = [*keys, "_v"]
    laid = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    cols = [f"_t{i}" for i in range(len(folds))]
    pieces = laid.groupBy(*keys, "_p").agg(*[F.sum(c).alias(c) for c in cols])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in cols],
                           *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"_n{c}") for c in cols])
    upto = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sums = laid.select(*keys, "_p", "_v", *cols, *[F.sum(c).over(upto).alias(f"_c{c}") for c in cols])
    found = sums.join(pieces, [*keys, "_p"])
    # a value holds the places [end - count, end) of the sorted training set
    out = None
    for f, c in zip(folds, cols, strict=True):
        end = F.col(f"_b{c}") + F.col(f"_c{c}")
        n = F.col(f"_n{c}")
        part = found.select(*keys, "_v", (end - F.col(c)).alias("a"), end.alias("e"),
                            F.floor((n - 1) / 2).alias("low"), F.floor(n / 2).alias("high"))
        part = part.filter("(a <= low AND low < e) OR (a <= high AND high < e)").groupBy(*keys) \
            .agg(((F.min("_v") + F.max("_v")) / 2).alias("median_pred")).withColumn(fold_col, F.lit(f).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def baselines(df: DataFrame, y: str, by: str | None = None, fold_col: str = "fold") -> DataFrame:
    """Predict the training mean / exact training median per fold.

    Mean: per-fold sums once, training = total - fold; median:
    :func:`training_medians`.  Returns (by, model, fold, mae, rmse, r2).
    """
    keys = [by] if by else []
    per = df.groupBy(*keys, fold_col).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    w = Window.partitionBy(*keys)
    means = per.select(*keys, fold_col,
                       F.try_divide(F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n")).alias("mean_pred"))
    consts = means.join(training_medians(df, y, keys, fold_col), keys + [fold_col], "left")
    # one row per key and fold: small enough for Spark to broadcast by itself
    preds = df.select(*keys, fold_col, F.col(y).alias("y")).join(consts, keys + [fold_col]).select(
        *keys, fold_col, "y", F.explode(F.array(
            F.struct(F.lit("Mean_Baseline").alias("model"), F.col("mean_pred").alias("pred")),
            F.struct(F.lit("Median_Baseline").alias("model"), F.col("median_pred").alias("pred")))).alias("m"))
    return regression_metrics(preds.select(*keys, fold_col, "y", "m.model", "m.pred"), "y", "pred",
                              by=keys + ["model", fold_col])


# ---------------------------------------------------------------------------
# Sufficient statistics
# ---------------------------------------------------------------------------

import math  # noqa: E402

import numpy as np  # noqa: E402

from notewise.functions.stats import two_sided_p  # noqa: E402


def _q(c: str):
    return F.col(f"`{c}`")


def gram_by(df: DataFrame, cols: Sequence[str], y: str, by: Sequence[str]) -> dict:
    """One pass: n, sum x, sum x x', sum x y, sum y, sum y^2 per key.

    Returns {key tuple: dict of numpy arrays}.  p(p+1)/2 sums per key.
    """
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(_q(y)).alias("_sy"), F.sum(_q(y) * _q(y)).alias("_syy")]
    aggs += [F.sum(_q(c)).alias(f"_sx{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(_q(c) * _q(y)).alias(f"_sxy{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(_q(cols[i]) * _q(cols[j])).alias(f"_sxx{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in df.groupBy(*by).agg(*aggs).collect():
        sxx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                sxx[i, j] = sxx[j, i] = r[f"_sxx{i}_{j}"] or 0.0
        out[tuple(r[b] for b in by)] = {
            "n": float(r["_n"]), "sy": float(r["_sy"] or 0.0), "syy": float(r["_syy"] or 0.0),
            "sx": np.array([r[f"_sx{i}"] or 0.0 for i in range(p)]),
            "sxy": np.array([r[f"_sxy{i}"] or 0.0 for i in range(p)]), "sxx": sxx}
    return out


def _minus(total: dict, part: dict) -> dict:
    return {k: total[k] - part[k] for k in total}


def _add(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def _predict_col(features: Sequence[str], coef_col: str = "_w", icpt_col: str = "_b"):
    """intercept + sum_j w_j x_j, coefficients from a joined per-fold row."""
    terms = [F.col(coef_col)[j] * _q(c) for j, c in enumerate(features)]
    expr = F.col(icpt_col)
    for t in terms:
        expr = expr + t
    return expr


def _score_folds(df: DataFrame, features: Sequence[str], y: str, coefs: dict, keys: Sequence[str],
                 fold_col: str, model: str, clip: bool = True) -> DataFrame:
    """Predict test rows with per-(key, fold) linear coefficients, return per-fold metrics."""
    spark = df.sparkSession
    rows = [(*k, float(b), [float(x) for x in w]) for k, (b, w) in coefs.items()]
    schema = ", ".join([f"`{c}` {t}" for c, t in zip(list(keys) + [fold_col], ["string"] * len(keys) + ["bigint"])]
                       + ["_b double", "_w array<double>"])
    cdf = spark.createDataFrame(rows, schema)
    j = df.join(F.broadcast(cdf), list(keys) + [fold_col])
    pred = _predict_col(features)
    j = j.select(*keys, fold_col, _q(y).alias("y"), (clip01(pred) if clip else pred).alias("pred"))
    m = regression_metrics(j, "y", "pred", by=list(keys) + [fold_col])
    return m.withColumn("model", F.lit(model))


# ---------------------------------------------------------------------------
# Ridge on standardised features (population std from the training set)
# ---------------------------------------------------------------------------

# Variance of a column, as a share of its mean square, that sums of squares
# cannot tell from zero.
FLAT = 1e-10


def ridge_solve(st: dict, alpha: float = 1.0):
    """(intercept, w) in original units from training sums.

    A column whose variance is within rounding of zero (``FLAT`` of its mean
    square) is constant: its weight is 0.
    """
    n = st["n"]
    mu = st["sx"] / n
    ybar = st["sy"] / n
    square = np.diag(st["sxx"]) / n
    var = square - mu * mu
    flat = var <= FLAT * square
    sd = np.sqrt(np.where(flat, 1.0, var))
    zz = (st["sxx"] - n * np.outer(mu, mu)) / np.outer(sd, sd)
    zy = (st["sxy"] - n * mu * ybar) / sd
    zz[flat], zz[:, flat], zy[flat] = 0.0, 0.0, 0.0
    b = np.linalg.solve(zz + alpha * np.eye(len(mu)), zy)
    w = b / sd
    return ybar - mu @ w, w


def ridge_cv(df: DataFrame, y: str, features: Sequence[str], by: str | None = None,
             fold_col: str = "fold", alpha: float = 1.0) -> DataFrame:
    """Per-fold ridge fits from one Gram pass (training = total - fold)."""
    keys = [by] if by else []
    g = gram_by(df, features, y, keys + [fold_col])
    coefs = {}
    for key in {k[:-1] for k in g}:
        parts = {k[-1]: v for k, v in g.items() if k[:-1] == key}
        total = None
        for v in parts.values():
            total = v if total is None else _add(total, v)
        for f, v in parts.items():
            coefs[(*key, f)] = ridge_solve(_minus(total, v), alpha)
    return _score_folds(df, features, y, coefs, keys, fold_col, "Ridge_Regression")


# ---------------------------------------------------------------------------
# Random-intercept linear mixed model by REML.
#
# With theta = var(u)/var(e) and group i of n_i rows, s_i = sum x, t_i = sum y:
#   X'V^-1X = sum XX' - sum_i w_i s_i s_i',  w_i = theta / (1 + n_i theta)
# and likewise for X'V^-1y, y'V^-1y.  w_i depends on n_i only, so Spark sums
# s s', s t, t^2 per (fold, group size); the driver profiles the REML
# criterion over theta with p x p algebra.
# ---------------------------------------------------------------------------

def lme_stats(df: DataFrame, y: str, fixed: Sequence[str], group_col: str, by: Sequence[str]) -> dict:
    """Row Gram and per-group-size sums, keyed by ``by``."""
    p = len(fixed)
    rows = gram_by(df, fixed, y, by)
    grp = df.groupBy(*by, group_col).agg(F.count(F.lit(1)).alias("_ni"), F.sum(_q(y)).alias("_t"),
                                         *[F.sum(_q(c)).alias(f"_s{i}") for i, c in enumerate(fixed)])
    aggs = [F.count(F.lit(1)).alias("_g"), F.sum(F.col("_t") * F.col("_t")).alias("_tt")]
    aggs += [F.sum(F.col(f"_s{i}") * F.col("_t")).alias(f"_st{i}") for i in range(p)]
    aggs += [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_ss{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {k: {"rows": v, "sizes": {}} for k, v in rows.items()}
    for r in grp.groupBy(*by, "_ni").agg(*aggs).collect():
        ss = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                ss[i, j] = ss[j, i] = r[f"_ss{i}_{j}"] or 0.0
        key = tuple(r[b] for b in by)
        out[key]["sizes"][int(r["_ni"])] = {"g": float(r["_g"]), "tt": float(r["_tt"] or 0.0),
                                            "st": np.array([r[f"_st{i}"] or 0.0 for i in range(p)]), "ss": ss}
    return out


def _combine_lme(parts: list[dict], sign: list[int]) -> dict:
    rows = None
    sizes: dict = {}
    for part, sg in zip(parts, sign):
        r = {k: sg * v for k, v in part["rows"].items()}
        rows = r if rows is None else _add(rows, r)
        for n, d in part["sizes"].items():
            cur = sizes.get(n)
            add = {k: sg * v for k, v in d.items()}
            sizes[n] = add if cur is None else _add(cur, add)
    sizes = {n: d for n, d in sizes.items() if d["g"] > 0.5}
    return {"rows": rows, "sizes": sizes}


def independent_columns(gram: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns of a design that are no combination of columns before them, from its Gram matrix.

    Cholesky step by step: what is left of a column after the kept ones, as a
    share of its own square, tells whether it adds anything.
    """
    left = gram.astype(np.float64).copy()
    kept = []
    for j in range(len(gram)):
        if left[j, j] > tol * gram[j, j] and gram[j, j] > 0:
            kept.append(j)
            c = left[:, j] / left[j, j]
            left = left - np.outer(c, left[j, :])
    return kept


def _columns(st: dict, kept: list[int]) -> dict:
    """The statistics of some columns of the design."""
    at = np.ix_(kept, kept)
    rows = {**st["rows"], "sx": st["rows"]["sx"][kept], "sxy": st["rows"]["sxy"][kept], "sxx": st["rows"]["sxx"][at]}
    return {"rows": rows, "sizes": {n: {**d, "st": d["st"][kept], "ss": d["ss"][at]} for n, d in st["sizes"].items()}}


def _reml_parts(st: dict, theta: float):
    r = st["rows"]
    A, b, c = r["sxx"].copy(), r["sxy"].copy(), r["syy"]
    logdet_v = 0.0
    for n, d in st["sizes"].items():
        w = theta / (1.0 + n * theta)
        A -= w * d["ss"]
        b -= w * d["st"]
        c -= w * d["tt"]
        logdet_v += d["g"] * math.log1p(n * theta)
    return A, b, c, logdet_v


def reml_objective(st: dict, theta: float) -> float:
    A, b, c, logdet_v = _reml_parts(st, theta)
    N, p = st["rows"]["n"], len(b)
    sign, logdet_a = np.linalg.slogdet(A)
    if sign <= 0:
        return float("inf")
    beta = np.linalg.solve(A, b)
    rss = c - b @ beta
    if rss <= 0:
        return float("inf")
    return (N - p) * math.log(rss / (N - p)) + logdet_v + logdet_a


def fit_reml(st: dict, lo: float = -12.0, hi: float = 8.0) -> dict:
    """Profile REML over log(theta) (golden section after a coarse grid), theta=0 included.

    A column that is a combination of columns before it (an empty cell, say) cannot be estimated: it is left out of
    the fit, its coefficient is 0 and its standard error NaN; ``dropped`` lists such columns.
    """
    p_all = len(st["rows"]["sxy"])
    kept = independent_columns(st["rows"]["sxx"])
    if len(kept) < p_all:
        fit = fit_reml(_columns(st, kept), lo, hi)
        beta, se = np.zeros(p_all), np.full(p_all, np.nan)
        beta[kept], se[kept] = fit["beta"], fit["se"]
        return {**fit, "beta": beta, "se": se, "dropped": [j for j in range(p_all) if j not in kept]}
    grid = np.linspace(lo, hi, 41)
    vals = [reml_objective(st, math.exp(g)) for g in grid]
    i = int(np.argmin(vals))
    a, bnd = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    phi = (math.sqrt(5) - 1) / 2
    x1, x2 = bnd - phi * (bnd - a), a + phi * (bnd - a)
    f1, f2 = reml_objective(st, math.exp(x1)), reml_objective(st, math.exp(x2))
    for _ in range(80):
        if f1 < f2:
            bnd, x2, f2 = x2, x1, f1
            x1 = bnd - phi * (bnd - a)
            f1 = reml_objective(st, math.exp(x1))
        else:
            a, x1, f1 = x1, x2, f2
            x2 = a + phi * (bnd - a)
            f2 = reml_objective(st, math.exp(x2))
    theta = math.exp((a + bnd) / 2)
    if reml_objective(st, 0.0) <= reml_objective(st, theta):
        theta = 0.0
    A, b, c, _ = _reml_parts(st, theta)
    N, p = st["rows"]["n"], len(b)
    beta = np.linalg.solve(A, b)
    sigma2 = (c - b @ beta) / (N - p)
    cov = sigma2 * np.linalg.inv(A)
    return {"theta": theta, "beta": beta, "sigma2": sigma2, "se": np.sqrt(np.diag(cov)),
            "group_var": theta * sigma2, "dropped": []}


class LMEModel:
    """A fitted random-intercept model; rows never leave Spark."""

    def __init__(self, fit: dict, fixed: Sequence[str], group_col: str, y: str, names: Sequence[str] | None = None):
        self.fit, self.fixed, self.group_col, self.y = fit, list(fixed), group_col, y
        self.names = list(names or fixed)

    def _linear(self):
        expr = F.lit(0.0)
        for bj, c in zip(self.fit["beta"], self.fixed):
            expr = expr + F.lit(float(bj)) * _q(c)
        return expr

    def predict(self, df: DataFrame, out: str = "predicted_adherence") -> DataFrame:
        """Fixed effects only (population prediction)."""
        return df.withColumn(out, self._linear())

    def blups(self, df: DataFrame) -> DataFrame:
        """Per-group random intercepts u_i = theta (t_i - s_i'beta) / (1 + n_i theta)."""
        th = self.fit["theta"]
        g = df.groupBy(self.group_col).agg(F.count(F.lit(1)).alias("_n"),
                                            F.sum(_q(self.y) - self._linear()).alias("_r"))
        return g.select(self.group_col, (F.lit(th) * F.col("_r") / (F.lit(1.0) + F.col("_n") * F.lit(th))).alias("blup"))

    def fitted(self, df: DataFrame, out: str = "predicted_adherence") -> DataFrame:
        """Fixed effects + the group's BLUP."""
        return df.join(self.blups(df), self.group_col, "left").withColumn(
            out, self._linear() + F.coalesce("blup", F.lit(0.0))).drop("blup")

    def residuals(self, df: DataFrame) -> DataFrame:
        """I8: fitted values, residual and absolute error."""
        f = self.fitted(df)
        return f.withColumn("residual", _q(self.y) - F.col("predicted_adherence")) \
            .withColumn("abs_error", F.abs("residual"))

    def coefficients(self, spark) -> DataFrame:
        """Parameter, Coefficient, Std_Error, p_value (+ group variance rows)."""
        rows = []
        dropped = {self.names[j] for j in self.fit.get("dropped", [])}
        for name, bj, se in zip(self.names, self.fit["beta"], self.fit["se"]):
            if name not in dropped:
                z = bj / se if se > 0 else float("nan")
                rows.append((name, float(bj), float(se), float(two_sided_p(z)) if se > 0 else None))
        rows.append(("Group Var", float(self.fit["group_var"]), None, None))
        rows.append(("Group Var / Scale", float(self.fit["theta"]), None, None))
        return spark.createDataFrame(rows, "Parameter string, Coefficient double, Std_Error double, p_value double")

    def dropped(self, spark) -> DataFrame:
        """(Parameter) of the columns that could not be estimated."""
        return spark.createDataFrame([(self.names[j],) for j in self.fit.get("dropped", [])], "Parameter string")

    def in_sample(self, df: DataFrame) -> DataFrame:
        """I8: MAE, RMSE and R^2 of the fitted values on the rows of ``df``."""
        f = self.fitted(df).select(F.lit(1).alias("_all"), _q(self.y).alias("y"), F.col("predicted_adherence").alias("pred"))
        return regression_metrics(f, "y", "pred", by="_all").drop("_all")

    def interactions(self, spark, level: float = 0.95) -> DataFrame:
        """Interaction terms (names with ':') with normal CIs."""
        from notewise.functions.stats import norm_ppf

        zc = norm_ppf(0.5 + level / 2)
        c = self.coefficients(spark).filter(F.col("Parameter").contains(":"))
        return c.withColumn("CI_Lower", F.col("Coefficient") - F.lit(zc) * F.col("Std_Error")) \
            .withColumn("CI_Upper", F.col("Coefficient") + F.lit(zc) * F.col("Std_Error"))


def fit_lme(df: DataFrame, y: str, fixed: Sequence[str], group_col: str,
            names: Sequence[str] | None = None) -> LMEModel:
    """Fit on the whole frame."""
    st = lme_stats(df, y, fixed, group_col, [])[()]
    return LMEModel(fit_reml(st), fixed, group_col, y, names)


def lme_cv(df: DataFrame, y: str, fixed: Sequence[str], group_col: str, by: str | None = None,
           fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """I5/I6 under CV: per-fold fits from one statistics pass (training = total - fold).

    Returns (fold metrics, out-of-fold predictions).
    """
    keys = [by] if by else []
    st = lme_stats(df, y, fixed, group_col, keys + [fold_col])
    coefs = {}
    for key in {k[:-1] for k in st}:
        parts = {k[-1]: v for k, v in st.items() if k[:-1] == key}
        allp = list(parts.values())
        for f, v in parts.items():
            train = _combine_lme(allp + [v], [1] * len(allp) + [-1])
            fit = fit_reml(train)
            coefs[(*key, f)] = (0.0, fit["beta"])
    spark = df.sparkSession
    rows = [(*k, float(b), [float(x) for x in w]) for k, (b, w) in coefs.items()]
    schema = ", ".join([f"`{c}` {t}" for c, t in zip(keys + [fold_col], ["string"] * len(keys) + ["bigint"])]
                       + ["_b double", "_w array<double>"])
    cdf = spark.createDataFrame(rows, schema)
    j = df.join(F.broadcast(cdf), keys + [fold_col]).withColumn(
        "predicted_adherence", clip01(_predict_col(fixed))).drop("_b", "_w")
    m = regression_metrics(j.select(*keys, fold_col, _q(y).alias("y"), F.col("predicted_adherence").alias("pred")),
                           "y", "pred", by=keys + [fold_col]).withColumn("model", F.lit("Linear_Mixed_Effects"))
    return m, j


# ---------------------------------------------------------------------------
# I4: random forest (MLlib), one fit per fold
# ---------------------------------------------------------------------------

def forest_cv(df: DataFrame, y: str, features: Sequence[str], by: str | None = None, fold_col: str = "fold",
              trees: int = 100, depth: int = 10, min_instances: int = 2, seed: int = 42) -> DataFrame:
    """I4: MLlib random forest per fold (all features per split), clipped predictions.

    Rows keep the number of their node in every tree: otherwise each task of each level is sent the whole forest.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    keys = [by] if by else []
    data = VectorAssembler(inputCols=list(features), outputCol="_fv").transform(df).persist()
    key_vals = [tuple(r) for r in data.select(*keys).distinct().collect()] if keys else [()]
    folds = _fold_values(data, fold_col)

    def subset(kv):
        sub = data
        for k, v in zip(keys, kv):
            sub = sub.filter(F.col(k) == v)
        return sub

    def fit(task):
        kv, f = task
        rf = RandomForestRegressor(featuresCol="_fv", labelCol=y, numTrees=trees, maxDepth=depth,
                                   minInstancesPerNode=min_instances, featureSubsetStrategy="all",
                                   seed=seed, predictionCol="_p", maxMemoryInMB=1024, cacheNodeIds=True)
        return task, rf.fit(subset(kv).filter(F.col(fold_col) != f))

    # the per-fold fits are independent: submit them together so their
    # level-by-level jobs share the cluster
    from concurrent.futures import ThreadPoolExecutor

    tasks = [(kv, f) for kv in key_vals for f in folds]
    with ThreadPoolExecutor(max_workers=min(len(tasks), 5)) as pool:
        models = list(pool.map(fit, tasks))
    out = None
    for (kv, f), model in models:
        pr = model.transform(subset(kv).filter(F.col(fold_col) == f)).select(
            *keys, fold_col, _q(y).alias("y"), clip01("_p").alias("pred"))
        out = pr if out is None else out.unionByName(pr)
    return regression_metrics(out, "y", "pred", by=keys + [fold_col]).withColumn("model", F.lit("Random_Forest"))


# ---------------------------------------------------------------------------
# An external model scored per Arrow batch
# ---------------------------------------------------------------------------

def score_external(df: DataFrame, predict, features: Sequence[str], y: str, by: str | None = None,
                   fold_col: str = "fold", model: str = "External") -> DataFrame:
    """``predict(ndarray n x p) -> ndarray n`` applied per Arrow batch, then H4-H7."""
    keys = [by] if by else []
    cols = keys + [fold_col, y] + list(features)

    def kernel(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf[list(features)].to_numpy(dtype=np.float64)
            p = np.clip(np.asarray(predict(x), dtype=np.float64).reshape(-1), 0.0, 1.0)
            out = pdf[keys + [fold_col]].copy()
            out["y"] = pdf[y].astype(float)
            out["pred"] = p
            yield out

    schema = ", ".join([f"`{k}` string" for k in keys] + [f"`{fold_col}` bigint", "y double", "pred double"])
    preds = df.select(*[_q(c) for c in cols]).mapInPandas(kernel, schema)
    return regression_metrics(preds, "y", "pred", by=keys + [fold_col]).withColumn("model", F.lit(model))


# ---------------------------------------------------------------------------
# Fitted parameters as tables
# ---------------------------------------------------------------------------

def save_model(model: LMEModel, path: str, blups: DataFrame | None = None) -> None:
    """Write a fitted LME as parquet tables: parameters (one row per fixed
    effect, plus theta and sigma^2) and optionally the BLUP table."""
    spark = SparkSessionRef.get()
    rows = [(i, name, col, float(b), float(se)) for i, (name, col, b, se) in
            enumerate(zip(model.names, model.fixed, model.fit["beta"], model.fit["se"]))]
    spark.createDataFrame(rows, "pos int, name string, col string, beta double, se double") \
        .write.mode("overwrite").parquet(f"{path}/fixed")
    spark.createDataFrame([(float(model.fit["theta"]), float(model.fit["sigma2"]), model.group_col, model.y)],
                          "theta double, sigma2 double, group_col string, y string") \
        .write.mode("overwrite").parquet(f"{path}/variance")
    if blups is not None:
        blups.write.mode("overwrite").parquet(f"{path}/blups")


def load_model(spark, path: str) -> LMEModel:
    fx = sorted(spark.read.parquet(f"{path}/fixed").collect(), key=lambda r: r.pos)
    v = spark.read.parquet(f"{path}/variance").first()
    fit = {"beta": np.array([r.beta for r in fx]), "se": np.array([r.se for r in fx]),
           "theta": v.theta, "sigma2": v.sigma2, "group_var": v.theta * v.sigma2}
    return LMEModel(fit, [r.col for r in fx], v.group_col, v.y, [r.name for r in fx])


class SparkSessionRef:
    @staticmethod
    def get():
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
