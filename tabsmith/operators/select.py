"""Feature selection (K1-K8).

Scores come from one grouped pass: ``groupBy(label)`` with count, sum and
sum of squares of every feature (partial aggregation per task; the output
has one row per class), followed by a one-row aggregate over those class
rows.  Features are numeric non-bool columns minus the target; nulls count
as 0, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import c, nan_to_null
from tabsmith.operators.preprocess import StepError, numeric_plain


def _x(name):
    return F.coalesce(c(name).cast("double"), F.lit(0.0))


def _long(row_df: DataFrame, feats, expr_of) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), expr_of(i).alias("score"))
               for i, f in enumerate(feats)]
    return row_df.select(F.inline(F.array(*structs)))


def class_moments(df: DataFrame, feats, target) -> DataFrame:
    """One row per class: n, sum and sum of squares of each feature."""
    return (df.where(c(target).isNotNull())
            .groupBy(c(target).alias("__y"))
            .agg(F.count(F.lit(1)).cast("double").alias("__n"),
                 *[F.sum(_x(f)).alias(f"s{i}") for i, f in enumerate(feats)],
                 *[F.sum(_x(f) * _x(f)).alias(f"q{i}") for i, f in enumerate(feats)]))


def anova_f(df: DataFrame, feats, target) -> DataFrame:
    """K3: one-way ANOVA F per feature (sklearn ``f_classif``)."""
    cm = class_moments(df, feats, target)
    aggs = [F.sum("__n").alias("N"), F.count(F.lit(1)).cast("double").alias("K")]
    for i in range(len(feats)):
        aggs += [F.sum(f"s{i}").alias(f"S{i}"), F.sum(f"q{i}").alias(f"Q{i}"),
                 F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("__n")).alias(f"B{i}")]
    row = cm.agg(*aggs)

    def f_of(i):
        ssb = F.col(f"B{i}") - F.col(f"S{i}") * F.col(f"S{i}") / F.col("N")
        ssw = F.col(f"Q{i}") - F.col(f"B{i}")
        return (ssb / (F.col("K") - 1)) / (ssw / (F.col("N") - F.col("K")))
    return _long(row, feats, f_of)


def chi2_scores(df: DataFrame, feats, target) -> DataFrame:
    """K5: sklearn ``chi2`` -- observed feature sums per class vs class share x total."""
    cm = class_moments(df, feats, target).persist()          # one row per class
    t = cm.agg(F.sum("__n").alias("N"), *[F.sum(f"s{i}").alias(f"T{i}") for i in range(len(feats))]).first()
    j = cm
    terms = []
    for i in range(len(feats)):
        exp = F.col("__n") / F.lit(t["N"]) * F.lit(t[f"T{i}"])
        terms.append(F.sum((F.col(f"s{i}") - exp) * (F.col(f"s{i}") - exp) / exp).alias(f"c{i}"))
    row = j.agg(*terms)
    return _long(row, feats, lambda i: F.col(f"c{i}"))


def f_regression_scores(df: DataFrame, feats, target) -> DataFrame:
    """K4: F = r^2 / (1 - r^2) * (n - 2)."""
    y = c(target).cast("double")
    d = df.where(y.isNotNull())
    row = d.agg(F.count(F.lit(1)).cast("double").alias("n"),
                *[F.corr(_x(f), y).alias(f"r{i}") for i, f in enumerate(feats)])
    return _long(row, feats, lambda i: F.col(f"r{i}") * F.col(f"r{i}") / (1 - F.col(f"r{i}") * F.col(f"r{i}"))
                 * (F.col("n") - 2))


def mutual_info_scores(df: DataFrame, feats, target, classification: bool = True, bins: int = 10) -> DataFrame:
    """K6 (re-aimed): mutual information of equal-width-binned features with the target.

    The reference's kNN estimator is single-machine; this is the binned
    plug-in estimator, sum p(x,y) ln(p(x,y) / (p(x) p(y))), from joint counts.
    """
    from tabsmith.functions.stats import long_values
    y = c(target)
    d = df.where(y.isNotNull())
    mm = d.agg(*[F.min(_x(f)).alias(f"lo{i}") for i, f in enumerate(feats)],
               *[F.max(_x(f)).alias(f"hi{i}") for i, f in enumerate(feats)],
               *([] if classification else [F.min(y.cast("double")).alias("ylo"),
                                           F.max(y.cast("double")).alias("yhi")])).first()

    def binx(expr, lo, hi):
        if lo is None or hi == lo:
            return F.lit(0)
        return F.least(F.floor((expr - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    ycol = y.cast("string") if classification else binx(y.cast("double"), mm["ylo"], mm["yhi"]).cast("string")
    binned = d.select(ycol.alias("__yb"), *[binx(_x(f), mm[f"lo{i}"], mm[f"hi{i}"]).alias(f)
                                           for i, f in enumerate(feats)])
    lv = long_values(binned, feats, "int", keep=["__yb"])
    joint = lv.groupBy("column", "value", "__yb").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    from pyspark.sql.window import Window
    wx = Window.partitionBy("column", "value")
    wy = Window.partitionBy("column", "__yb")
    wn = Window.partitionBy("column")
    j = (joint.withColumn("nx", F.sum("nxy").over(wx)).withColumn("ny", F.sum("nxy").over(wy))
         .withColumn("n", F.sum("nxy").over(wn)))
    mi = j.groupBy("column").agg(F.sum(F.col("nxy") / F.col("n") * F.log(
        F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("score"))
    pos = d.sparkSession.createDataFrame([(i, f) for i, f in enumerate(feats)], "position int, feature string")
    return pos.join(mi.withColumnRenamed("column", "feature"), "feature", "left") \
        .select("position", "feature", F.coalesce("score", F.lit(0.0)).alias("score"))


def variance_scores(df: DataFrame, feats) -> DataFrame:
    """K2: population variance with nulls as 0."""
    row = df.agg(*[F.var_pop(_x(f)).alias(f"v{i}") for i, f in enumerate(feats)])
    return _long(row, feats, lambda i: F.col(f"v{i}"))


def correlation_drop(df: DataFrame, feats, threshold: float) -> list[str]:
    """K1: drop a column when |corr| with any earlier column exceeds the threshold."""
    from tabsmith.operators.profile import correlation_long
    if len(feats) < 2:
        return []
    pairs = correlation_long(df, feats).where(F.abs(F.col("corr")) > threshold).select("col_b").distinct()
    hit = {r[0] for r in pairs.collect()}  # at most len(feats) names
    return [f for f in feats if f in hit]


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """K8: keep the k best (ties at the cut -> later feature, like a stable ascending argsort tail)."""
    n = scores.count()
    k = min(max(1, int(k)), max(1, n))
    from pyspark.sql.window import Window
    w = Window.orderBy(F.col("score").desc_nulls_last(), F.col("position").desc())  # <= #features rows
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def selection_scores(df: DataFrame, p: dict) -> DataFrame:
    """Scores + selected flag per feature for a feature_selection step spec."""
    df = nan_to_null(df)
    method = p.get("method", "correlation")
    target = p.get("target")
    feats = numeric_plain(df, exclude=[target] if target and target in df.columns else [])
    spark = df.sparkSession
    if method == "correlation":
        drop = set(correlation_drop(df, feats, float(p.get("threshold", 0.95))))
        return spark.createDataFrame([(i, f, None, f not in drop) for i, f in enumerate(feats)],
                                     "position int, feature string, score double, selected boolean")
    if method == "variance":
        sc = variance_scores(df, feats)
        return sc.withColumn("selected", F.col("score") > float(p.get("threshold", 0.0)))
    if method in ("select_k_best", "rfe") and not (target and target in df.columns):
        raise StepError(f"{method} requires a target column")
    if method == "select_k_best":
        fn = str(p.get("score_func", "f_classif"))
        if fn == "f_regression":
            sc = f_regression_scores(df, feats, target)
        elif fn == "chi2":
            sc = chi2_scores(df, feats, target)
        elif fn in ("mutual_info_classif", "mutual_info_regression"):
            sc = mutual_info_scores(df, feats, target, classification=(fn == "mutual_info_classif"))
        else:
            sc = anova_f(df, feats, target)
        return top_k(sc, int(p.get("k", 20))).drop("rank")
    if method == "rfe":
        from tabsmith.operators.estimators import rfe_ranking
        return rfe_ranking(df, feats, target, int(p.get("k", 10)), p.get("task_type", "classification"))
    raise StepError(f"unknown feature_selection method {method}")


def fit_selection(df: DataFrame, p: dict) -> dict:
    rows = selection_scores(df, p).collect()   # one row per feature
    return {"drop": [r["feature"] for r in rows if not r["selected"]],
            "scores": {r["feature"]: r["score"] for r in rows}}
