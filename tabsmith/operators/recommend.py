"""Batch algorithm recommendation (R1-R15, SC2, W4).

Re-aimed as a table job: ``meta_features`` (one row per dataset, computed
by Spark aggregates over that dataset) joined with the per-dataset
requirements and, on ``task_type``, with the 45-row registry (broadcast),
scored by rule expressions, ranked top 5 per dataset.  The rules are
written once as SQL expressions so the Spark plan and the DuckDB oracle
evaluate the same text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.functions.columns import c, finite, is_numeric
from tabsmith.functions.correlation import correlation_matrix
from tabsmith.plans.registry import registry

FAM = "lower(family)"
NM = "lower(name)"
K = "key"
INTERP = "lower(coalesce(interpretability, 'Medium'))"
PRESET = "lower(trim(coalesce(automobile_preset, '')))"


def _has(s, sub):
    return f"instr({s}, '{sub}') > 0"


LIN = _has(FAM, "linear")
SVM = _has(FAM, "svm")
TREE = _has(FAM, "tree")
BOOST = _has(FAM, "boost")
KNN = f"({_has(FAM, 'neighbors')} OR {_has(FAM, 'knn')})"


def _base(vals):
    """R9 base score by family, first match; vals = (linear, svm, tree, boost, knn, cluster, dimred, else)."""
    a = vals
    return (f"CASE WHEN {LIN} THEN {a[0]} WHEN {SVM} THEN {a[1]} WHEN {TREE} AND NOT {BOOST} THEN {a[2]} "
            f"WHEN {BOOST} THEN {a[3]} WHEN {KNN} THEN {a[4]} WHEN {_has(FAM, 'cluster')} THEN {a[5]} "
            f"WHEN ({_has(FAM, 'dimred')} OR {_has(FAM, 'reduction')}) THEN {a[6]} ELSE {a[7]} END")


# ---- fixed values: base scores per family class (accuracy, speed, interpretability, robustness)
BASE_ACC = (65, 75, 80, 88, 70, 60, 55, 70)
BASE_SPEED = (90, 55, 75, 60, 70, 80, 85, 70)
BASE_INTERP = (95, 55, 70, 35, 45, 55, 60, 60)
BASE_ROBUST = (75, 80, 85, 80, 60, 60, 60, 70)

SMALL_HIGH = f"(n_samples > 0 AND n_samples < 1000 AND {INTERP} = 'high')"
LIN_OR_LOGIT = f"({LIN} OR {_has(NM, 'logistic')})"
CATGBM = f"({_has(K, 'catboost')} OR {_has(K, 'lightgbm')})"

ACC_ADJ = " + ".join([
    f"CASE WHEN {SMALL_HIGH} THEN (CASE WHEN {LIN_OR_LOGIT} THEN 8 ELSE -5 END) ELSE 0 END",
    f"CASE WHEN n_features > 100 AND n_samples > 10000 AND ({TREE} OR {BOOST}) THEN 6 ELSE 0 END",
    f"CASE WHEN n_categorical > 10 AND {CATGBM} THEN 10 ELSE 0 END",
    f"CASE WHEN linearity_score >= 0.7 AND {LIN} THEN 6 ELSE 0 END",
    f"CASE WHEN linearity_score < 0.4 AND ({BOOST} OR {TREE}) THEN 6 ELSE 0 END",
    f"CASE WHEN {_has(PRESET, 'car price')} AND ({_has(K, 'xgboost')} OR {_has(K, 'lightgbm')} "
    f"OR {_has(NM, 'random forest')}) THEN 8 ELSE 0 END",
    f"CASE WHEN {_has(PRESET, 'fuel')} AND ({_has(NM, 'gradient')} OR {LIN}) THEN 6 ELSE 0 END",
    f"CASE WHEN {_has(PRESET, 'segmentation')} AND task_type = 'clustering' "
    f"AND ({_has(K, 'kmeans')} OR {_has(K, 'dbscan')}) THEN 6 ELSE 0 END"])

SPEED_ADJ = " + ".join([
    f"CASE WHEN n_categorical > 10 AND {CATGBM} THEN 3 ELSE 0 END",
    f"CASE WHEN lower(coalesce(training_time, 'Moderate')) = 'fast' AND ({BOOST} OR {SVM}) THEN -10 ELSE 0 END",
    f"CASE WHEN lower(coalesce(training_time, 'Moderate')) = 'fast' AND {LIN} THEN 6 ELSE 0 END",
    f"CASE WHEN lower(coalesce(prediction_speed, 'Moderate')) = 'fast' AND {KNN} THEN -10 ELSE 0 END",
    f"CASE WHEN lower(coalesce(deployment_size, 'Medium')) = 'small' AND ({BOOST} OR {_has(NM, 'forest')}) "
    f"THEN -3 ELSE 0 END"])

INTERP_ADJ = " + ".join([
    f"CASE WHEN {SMALL_HIGH} AND {LIN_OR_LOGIT} THEN 5 ELSE 0 END",
    f"CASE WHEN {INTERP} = 'high' AND ({BOOST} OR {_has(K, 'xgboost')}) THEN -20 ELSE 0 END",
    f"CASE WHEN {INTERP} = 'high' AND {LIN} THEN 5 ELSE 0 END"])

IMBALANCED = (f"(class_imbalance > 0.7 AND task_type = 'classification' AND ({_has(NM, 'randomforest')} "
              f"OR {_has(NM, 'logistic')} OR {SVM}))")
ROBUST_ADJ = " + ".join([
    f"CASE WHEN {IMBALANCED} THEN 8 ELSE 0 END",
    f"CASE WHEN noise_level = 'High' AND ({_has(NM, 'ridge')} OR {SVM} OR {TREE}) THEN 8 ELSE 0 END",
    f"CASE WHEN corr_high_pair_ratio > 0.05 AND ({_has(NM, 'ridge')} OR {_has(NM, 'lasso')} OR {LIN}) "
    f"THEN 6 ELSE 0 END"])


def _clip(e):
    return f"greatest(0, least(100, {e}))"


SCORES = {
    "accuracy": _clip(f"{_base(BASE_ACC)} + {ACC_ADJ}"),
    "speed": _clip(f"{_base(BASE_SPEED)} + {SPEED_ADJ}"),
    "interpretability": _clip(f"{_base(BASE_INTERP)} + {INTERP_ADJ}"),
    "robustness": _clip(f"{_base(BASE_ROBUST)} + {ROBUST_ADJ}"),
}

KEEP = (f"NOT (coalesce(must_be_interpretable, FALSE) AND interpretability_score < 60) "
        f"AND NOT (coalesce(must_be_fast, FALSE) AND speed_score < 60) "
        f"AND NOT (coalesce(must_handle_categorical, FALSE) AND n_categorical > 0 AND NOT ({CATGBM} "
        f"OR family IN ('Tree-based', 'Boosting', 'Linear')))")

WTOT = "greatest(1, w_accuracy + w_speed + w_interpretability + w_robustness)"


def _wn(w, rnd):
    return f"{rnd}({w} * 100.0 / {WTOT}, 0)"


def total_expr(rnd: str = "bround") -> str:
    """R8 + R12: normalised weights, weighted sum / 100 + feedback bump, clipped, half-even rounded."""
    s = (f"(accuracy_score * {_wn('w_accuracy', rnd)} + speed_score * {_wn('w_speed', rnd)} "
         f"+ interpretability_score * {_wn('w_interpretability', rnd)} "
         f"+ robustness_score * {_wn('w_robustness', rnd)}) / 100.0 + coalesce(bias, 0.0)")
    return f"CAST({rnd}({_clip(s)}, 0) AS INT)"


REQ_SCHEMA = ("dataset_id string, task_type string, interpretability string, training_time string, "
              "prediction_speed string, deployment_size string, must_be_interpretable boolean, must_be_fast boolean, "
              "must_handle_categorical boolean, w_accuracy int, w_speed int, w_interpretability int, "
              "w_robustness int, automobile_preset string, user_id string")


def score_candidates(meta: DataFrame, req: DataFrame, bias: DataFrame | None = None,
                     reg: DataFrame | None = None) -> DataFrame:
    """Every available, task-matching card scored for every dataset."""
    spark = meta.sparkSession
    reg = reg if reg is not None else registry(spark)
    reg = reg.where("available")
    j = meta.join(req, "dataset_id").join(F.broadcast(reg), "task_type")   # registry: 45 rows
    if bias is not None:
        j = j.join(bias.withColumnRenamed("algorithm_key", "key"), ["user_id", "task_type", "key"], "left")
    else:
        j = j.withColumn("bias", F.lit(None).cast("double"))
    j = j.select("*", *[F.expr(v).cast("int").alias(f"{k}_score") for k, v in SCORES.items()],
                 F.expr(IMBALANCED).alias("class_weight_balanced"))
    j = j.where(F.expr(KEEP))
    return j.withColumn("score_total", F.expr(total_expr("bround")))


#: Code of every rule that speaks for a card, with its condition.
REASONS = [
    ("small_data_linear", f"{SMALL_HIGH} AND {LIN_OR_LOGIT}"),
    ("wide_data_trees", f"n_features > 100 AND n_samples > 10000 AND ({TREE} OR {BOOST})"),
    ("many_categoricals", f"n_categorical > 10 AND {CATGBM}"),
    ("class_weights", IMBALANCED),
    ("noise_robust", f"noise_level = 'High' AND ({_has(NM, 'ridge')} OR {SVM} OR {TREE})"),
    ("collinear_regularised", f"corr_high_pair_ratio > 0.05 AND ({_has(NM, 'ridge')} OR {_has(NM, 'lasso')} OR {LIN})"),
    ("non_linear", f"linearity_score < 0.4 AND ({BOOST} OR {TREE})"),
    ("preset_car_price", f"{_has(PRESET, 'car price')} AND ({_has(K, 'xgboost')} OR {_has(K, 'lightgbm')} OR {_has(NM, 'random forest')})"),
    ("preset_fuel", f"{_has(PRESET, 'fuel')} AND ({_has(NM, 'gradient')} OR {LIN})"),
    ("preset_segmentation", f"{_has(PRESET, 'segmentation')} AND task_type = 'clustering' AND ({_has(K, 'kmeans')} OR {_has(K, 'dbscan')})"),
]


def with_reasons(scored: DataFrame) -> DataFrame:
    """``reasons``, the codes of the rules that speak for a card; empty where none does."""
    codes = F.array(*[F.when(F.expr(cond), F.lit(code)) for code, cond in REASONS])
    return scored.withColumn("reasons", F.filter(codes, lambda x: x.isNotNull()))


def recommend_top(meta: DataFrame, req: DataFrame, bias: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Top k per dataset; ties keep registry order (stable sort)."""
    s = score_candidates(meta, req, bias)
    w = Window.partitionBy("dataset_id").orderBy(F.col("score_total").desc(), F.col("position"))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("dataset_id", "rank", F.col("key").alias("algorithm_key"), F.col("name").alias("model_name"),
                    "family", "accuracy_score", "speed_score", "interpretability_score", "robustness_score",
                    "score_total", "class_weight_balanced"))


def suggestion_flags(top: DataFrame, meta: DataFrame, req: DataFrame) -> DataFrame:
    """Advanced / feature-engineering suggestion codes per dataset (prose not built)."""
    t = top.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_top"),
                                      F.max(F.col("family").isin("Linear", "Boosting").cast("int")).alias("stack"))
    j = meta.join(req, "dataset_id").join(t, "dataset_id", "left")
    sup = F.col("task_type").isin("classification", "regression")
    auto = F.col("automobile_preset").isNotNull()
    codes = F.array(
        F.when(F.col("n_top") >= 2, F.lit("ensemble")),
        F.when(F.col("stack") == 1, F.lit("stacking")),
        F.when(sup & (F.col("n_features") > 50), F.lit("hybrid")),
        F.when(F.col("n_top") > 0, F.lit("custom_pipeline")),
        F.when(F.col("missing_pct") > 1.0, F.lit("fe_impute")),
        F.when(F.col("n_categorical") > 0, F.lit("fe_encode")),
        F.when(sup, F.lit("fe_leakage_check")),
        F.when(auto, F.lit("fe_auto_age")), F.when(auto, F.lit("fe_auto_ratios")),
        F.when(auto & (F.instr(F.lower("automobile_preset"), "maintenance") > 0), F.lit("fe_auto_lags")))
    return j.select("dataset_id", F.filter(codes, lambda x: x.isNotNull()).alias("suggestions"))


# ------------------------------------------------------------------ meta-features

def meta_features(df: DataFrame, dataset_id: str, target: str | None = None, task: str | None = None,
                  linearity: DataFrame | None = None) -> DataFrame:
    """One row of dataset meta-features, from two aggregates over ``df``.

    numeric = numeric non-bool columns; categorical = the rest; the target is
    removed from both.  missing_pct averages the per-column null shares
    (target included).  Correlations use complete, finite numeric rows
    (needs >= 20 rows and >= 2 columns).  class_imbalance = largest class
    share, null counted as a class.  ``linearity`` (R6) is an optional
    one-row DataFrame with ``linearity_score``.
    """
    tgt = target if target and target in df.columns else None
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != tgt]
    cat = [f.name for f in df.schema.fields if f.name not in num and f.name != tgt]
    ncols = len(df.columns)
    flags = [(c(x).isNull() | (F.isnan(c(x)) if is_numeric(df.schema[x].dataType) else F.lit(False)))
             .cast("int").alias(f"__m{k}") for k, x in enumerate(df.columns)]
    row = df.select(*flags).agg(F.count(F.lit(1)).alias("n_samples"),
                                sum((F.sum(f"__m{k}") for k in range(len(df.columns))), F.lit(0)).alias("__nulls"))
    mean_abs = high = None
    if len(num) >= 2:
        # complete, finite rows only: the blocked pass sees no missing cell
        complete = reduce(lambda a, b: a & b, [finite(c(x)) for x in num])
        corr, shared = correlation_matrix(df.where(complete), [c(x).cast("double") for x in num])
        r = np.abs(corr[np.triu_indices(len(num), 1)])
        if shared[0, 0] >= 20:
            known = r[~np.isnan(r)]
            mean_abs = float(known.mean()) if len(known) else None
            high = float((known > 0.9).sum() / len(r))
    corr_cols = [F.lit(mean_abs).cast("double").alias("corr_mean_abs"), F.lit(high).cast("double").alias("corr_high_pair_ratio")]
    out = row.select(
        F.lit(dataset_id).alias("dataset_id"), F.col("n_samples").cast("bigint").alias("n_samples"),
        F.lit(ncols - (1 if tgt else 0)).cast("bigint").alias("n_features"),
        F.lit(len(num)).cast("bigint").alias("n_numeric"), F.lit(len(cat)).cast("bigint").alias("n_categorical"),
        F.lit(len(num) / max(1, len(num) + len(cat))).alias("numeric_ratio"),
        F.lit(len(cat) / max(1, len(num) + len(cat))).alias("categorical_ratio"),
        F.when(F.col("n_samples") > 0, F.col("__nulls") * 100.0 / (F.col("n_samples") * ncols)).alias("missing_pct"),
        *corr_cols)
    if tgt and task == "classification":
        # one number: largest class share (null counted as a class), inlined as a literal
        ci = (df.groupBy(c(tgt).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
              .agg((F.max("__n") / F.sum("__n")).alias("class_imbalance")).first()[0])
        out = out.withColumn("class_imbalance", F.lit(ci).cast("double"))
    else:
        out = out.withColumn("class_imbalance", F.lit(None).cast("double"))
    if linearity is not None:
        lin = linearity.select("linearity_score").first()[0]                # one number
        out = out.withColumn("linearity_score", F.lit(lin).cast("double"))
    else:
        out = out.withColumn("linearity_score", F.lit(None).cast("double"))
    noise = (F.when(F.col("linearity_score") >= 0.7, "Low").when(F.col("linearity_score") >= 0.4, "Medium")
             .when(F.col("linearity_score").isNotNull(), "High"))
    return out.withColumn("noise_level", noise)


def signature(meta: DataFrame) -> DataFrame:
    """SC2: md5 of the canonical (sorted-key) JSON of the meta-features, floats rounded to 6."""
    def num(col_name, digits=None):
        """Fixed-point text, trailing zeros stripped ('0.00089', '0.0'): identical in Spark and SQL."""
        x = F.col(col_name)
        if digits is None:
            return F.coalesce(x.cast("string"), F.lit("null"))
        t = x.cast(f"decimal(38,{digits})").cast("string")
        t = F.regexp_replace(F.regexp_replace(t, "0+$", ""), "[.]$", ".0")
        return F.coalesce(t, F.lit("null"))

    def txt(col_name):
        return F.coalesce(F.concat(F.lit('"'), F.col(col_name), F.lit('"')), F.lit("null"))
    parts = [("class_imbalance", num("class_imbalance", 6)), ("corr_high_pair_ratio", num("corr_high_pair_ratio", 6)),
             ("corr_mean_abs", num("corr_mean_abs", 6)), ("linearity_score", num("linearity_score", 6)),
             ("missing_pct", num("missing_pct", 6)), ("n_categorical", num("n_categorical")),
             ("n_features", num("n_features")), ("n_numeric", num("n_numeric")), ("n_samples", num("n_samples")),
             ("noise_level", txt("noise_level"))]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts]), F.lit("}"))
    return meta.select("dataset_id", body.alias("canonical"), F.md5(body).alias("signature"))


# ------------------------------------------------------------------ feedback

def feedback_bias(feedback: DataFrame, limit: int = 500) -> DataFrame:
    """Per (user, task, algorithm): (accepted - rejected) / (a + r) * 6, clipped to +-6;
    only each (user, task)'s ``limit`` highest-volume algorithms."""
    g = feedback.groupBy("user_id", "task_type", "algorithm_key").agg(
        F.sum(F.when(F.col("accepted") == 1, 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("accepted") == 0, 1).otherwise(0)).alias("r"))
    w = Window.partitionBy("user_id", "task_type").orderBy((F.col("a") + F.col("r")).desc(), "algorithm_key")
    g = g.withColumn("__rk", F.row_number().over(w)).where((F.col("__rk") <= limit) & (F.col("a") + F.col("r") > 0))
    b = (F.col("a") - F.col("r")) / F.greatest(F.lit(1.0), (F.col("a") + F.col("r")).cast("double"))
    return g.select("user_id", "task_type", "algorithm_key", F.greatest(F.lit(-6.0), F.least(F.lit(6.0), b * 6))
                    .alias("bias"))


#: Width of the hashed one-hot block of all categorical columns together.
HASHED = 1 << 10


def linearity_score(df: DataFrame, target: str, task: str, keys=None, seed: int = 42, width: int = HASHED) -> DataFrame:
    """Hold-out score of a plain linear model as a linearity proxy (one row).

    Numerics are imputed with their exact median; a categorical cell counts in one of ``width`` hashed
    columns, a missing one as its column's most frequent value, so a column with any number of values
    adds no state.  Linear (R^2 clipped to [-1, 1]) or logistic ((accuracy - .5) / .5 clipped to
    [0, 1]) model; 80/20 md5-bucket split over all rows (the reference samples 5 000).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tabsmith.functions.columns import hash_bucket
    from tabsmith.functions.stats import quantile_dict
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != target]
    cat = [f.name for f in df.schema.fields if f.name not in num and f.name != target
           and f.dataType.simpleString() == "string"]
    d = df.select(*[c(x).cast("double").alias(f"n{i}") for i, x in enumerate(num)], *[c(x).alias(f"c{i}") for i, x in enumerate(cat)],
                  c(target).alias("__t"), hash_bucket(keys or df.columns, seed).alias("__b")).where("__t is not null")
    # every pass reads these columns, and the hash is of whole rows: made once; the solver needs the memory
    base = d = d.persist(StorageLevel.DISK_ONLY)
    train = d.where(F.col("__b") >= 2000)
    median = quantile_dict(train, [f"n{i}" for i in range(len(num))], [0.5])
    for i in range(len(num)):
        v = F.col(f"n{i}")
        d = d.withColumn(f"n{i}", F.when(v.isNull() | F.isnan(v), F.lit(median[f"n{i}"][0] or 0.0)).otherwise(v))
    for i in range(len(cat)):
        often = train.where(f"c{i} is not null").groupBy(f"c{i}").count().orderBy(F.desc("count"), f"c{i}").first()
        d = d.withColumn(f"c{i}", F.coalesce(F.col(f"c{i}"), F.lit(often[0] if often else "")))
    parts = [f"n{i}" for i in range(len(num))]
    if cat:
        d = FeatureHasher(inputCols=[f"c{i}" for i in range(len(cat))], outputCol="__h", numFeatures=width).transform(d)
        parts.append("__h")
    d = VectorAssembler(inputCols=parts, outputCol="__f", handleInvalid="keep").transform(d)
    if task == "regression":
        d = d.withColumn("__y", F.col("__t").cast("double"))
        # a hashed block is not of full rank; the quasi-Newton solver needs no inverse
        est = LinearRegression(featuresCol="__f", labelCol="__y", regParam=0.0, solver="l-bfgs" if cat else "auto")
    else:
        # classes of the target: as many as a classifier can have
        d = StringIndexer(inputCol="__t", outputCol="__y", handleInvalid="keep").fit(d.where(F.col("__b") >= 2000)).transform(d)
        est = LogisticRegression(featuresCol="__f", labelCol="__y", maxIter=200)
    pred = est.fit(d.where(F.col("__b") >= 2000)).transform(d.where(F.col("__b") < 2000))
    if task == "regression":
        e = F.col("__y") - F.col("prediction")
        s = 1 - F.avg(e * e) / F.var_pop("__y")
        score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))
    else:
        acc = F.avg((F.col("__y") == F.col("prediction")).cast("double"))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (acc - 0.5) / 0.5))
    out = pred.agg(score.alias("linearity_score"))
    found = out.collect()                                       # one number
    base.unpersist()
    return df.sparkSession.createDataFrame(found, out.schema)
