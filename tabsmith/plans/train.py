"""Split, train, tune and batch-train.

``prepare`` coerces every feature to a number (F10) and assembles one
vector column shared by training, evaluation and explanation.  The split
is an md5 bucket of key columns (stable under re-reads and repartitioning).
Predictions keep the key columns so metrics and explanations join back on
them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import coerce_features, hash_bucket
from tabsmith.functions.partials import dealt_out
from tabsmith.operators import cells
from tabsmith.operators import compare as CMP
from tabsmith.operators import metrics as M
from tabsmith.operators.estimators import make_estimator
from tabsmith.plans import cards
from tabsmith.plans.registry import CARDS

TASK_OF = {k: t for k, _, t, _, _ in CARDS}


@dataclass
class Prepared:
    data: DataFrame                  # keys..., features, label (double), split
    features: list
    labels: list | None = None       # class values when the label was indexed
    keys: list = field(default_factory=list)


def prepare(df: DataFrame, target: str | None, keys, task: str, test_size: float = 0.2, seed: int = 42,
            features=None) -> Prepared:
    """F10 + VectorAssembler + T1 split; string class labels indexed alphabetically."""
    keys = list(keys)
    feats = list(features) if features else [x for x in df.columns if x != target and x not in keys]
    num = coerce_features(df.select(*keys, *feats, *([target] if target else [])), exclude=keys + ([target] if target else []))
    num = num.fillna(0.0, subset=feats)
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    out = va.transform(num)
    labels = None
    if target:
        if task == "classification":
            dt = dict(out.dtypes)[target]
            if dt == "string":
                si = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(out)
                labels = list(si.labels)
                out = si.transform(out)
            else:
                out = out.withColumn("label", F.col(target).cast("double"))
        else:
            out = out.withColumn("label", F.col(target).cast("double"))
    split = F.when(hash_bucket(keys, seed) < int(test_size * 10000), "test").otherwise("train")
    out = out.withColumn("split", split)
    cols = [*keys, "features", "split"] + (["label"] if target else [])
    return Prepared(out.select(*cols), feats, labels, keys)


@dataclass
class TrainResult:
    key: str
    model: object
    predictions: DataFrame
    metrics: DataFrame
    run: tuple
    train_seconds: float


def train(prep: Prepared, key: str, params: dict | None = None, task: str | None = None, save: bool = False) -> TrainResult:
    """T2-T4 + T11 + T12: fit on the train split, predict the test split, score, emit a run row.

    ``save`` writes the model too; its path and size go into the run row.
    """
    task = task or TASK_OF[key]
    est = make_estimator(key, params or {}, "features", "label")
    if task == "clustering":
        # every iteration and the assignment go over all rows: a small file's few row groups are dealt out
        prep = replace(prep, data=dealt_out(prep.data))
    tr = prep.data.where(F.col("split") == "train")
    te = prep.data.where(F.col("split") == "test")
    t0 = time.perf_counter()
    model = est.fit(tr if task in ("classification", "regression") else prep.data)
    fit_s = time.perf_counter() - t0
    scored = model.transform(te if task in ("classification", "regression") else prep.data)
    keep = [*prep.keys, *[c for c in ("label", "prediction", "probability", "cluster", "pca", "projection")
                          if c in scored.columns]]
    pred = scored.select(*keep).withColumn("model", F.lit(key))
    if task == "classification":
        met = CMP.to_long(M.classification_metrics(pred), ["accuracy", "precision", "recall", "f1_score",
                                                           "cohen_kappa", "matthews_corr"])
    elif task == "regression":
        met = CMP.to_long(M.regression_metrics(pred, n_features=len(prep.features)),
                          ["rmse", "mae", "r2", "explained_variance"])
    elif task == "clustering":
        met = M.cluster_counts(pred.withColumnRenamed("cluster", "cluster"), "cluster", ["model"]) \
            .groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("value")) \
            .withColumn("metric", F.lit("n_clusters")).select("model", "metric", "value")
    else:
        ev = getattr(model, "explainedVariance", None)
        v = float(np.sum(ev.toArray())) if ev is not None else None
        met = prep.data.sparkSession.createDataFrame([(key, "explained_variance_ratio", v)],
                                                     "model string, metric string, value double")
    # The metrics are computed once, in the scoring pass that they time
    t1 = time.perf_counter()
    rows = met.collect()                                       # a row per metric
    met = met.sparkSession.createDataFrame(rows, met.schema)
    infer_ms = (time.perf_counter() - t1) * 1000.0
    ops = {"training_time_s": fit_s, "inference_time_ms": infer_ms}
    path = None
    if save:
        path, size = save_model(model, prep.data.sparkSession)
        ops["model_size_mb"] = size / 1e6
    run = ("run_" + uuid.uuid4().hex, time.time(), time.time(), 0, task, key, key, "finished", json.dumps(ops),
           json.dumps(params or {}, default=str), path)
    return TrainResult(key, model, pred, met, run, fit_s)


def batch_train(prep: Prepared, keys, params: dict | None = None, parallel: int = 4, save: bool = False) -> list:
    """T5: one run per algorithm over the same prepared (cached) data; jobs interleave on the cluster."""
    prep.data.persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
            return list(ex.map(lambda k: train(prep, k, (params or {}).get(k), save=save), keys))
    finally:
        prep.data.unpersist()


def tune(prep: Prepared, key: str, mode: str = "grid", n_iter: int | None = None, folds: int = 3, parallel: int = 4,
         seed: int = 42, params: dict | None = None):
    """T6-T10 from the card: (best parameters, mean score over the folds, model refitted on the train split).

    ``grid`` tries every combination of the card's space, ``random`` at most 25 of them, ``bounded`` at most 50 uniform
    draws between its ends.  Folds are hash buckets of the keys; the score is R^2 or accuracy; of equal ones the
    first trial counts.  Ridge regression is answered from one Gram pass (``operators.linear_cv``); the others
    read the cached train split.
    """
    trials = {"grid": cards.grid, "random": lambda k: cards.random_trials(k, n_iter or cards.RANDOM_TRIALS, seed),
              "bounded": lambda k: cards.bounded_trials(k, n_iter or cards.BOUNDED_TRIALS, seed)}[mode](key)
    data = prep.data.where(F.col("split") == "train").withColumn("__fold", hash_bucket(prep.keys, seed + 1, folds).cast("int"))
    if key == "reg_ridge":
        from tabsmith.operators.linear_cv import ridge_search
        alpha, score, model = ridge_search(data, "features", "label", "__fold", [t["alpha"] for t in trials])
        return {"alpha": alpha}, score, model
    data = data.persist()
    good = (1 - F.avg((F.col("label") - F.col("prediction")) ** 2) / F.var_pop("label") if TASK_OF[key] == "regression"
            else F.avg((F.col("label") == F.col("prediction")).cast("double")))

    def score(job):
        trial, f = job
        model = make_estimator(key, {**(params or {}), **trial}).fit(data.where(F.col("__fold") != f))
        return model.transform(data.where(F.col("__fold") == f)).agg(good.alias("s")).first()["s"]

    try:
        estimators = [make_estimator(key, {**(params or {}), **t}) for t in trials]
        # the rows of a fold are binned once for all trees
        got = cells.search(data, "__fold", folds, estimators, parallel) if all(isinstance(e, cells.Tree) for e in estimators) else None
        if got is None:
            jobs = [(t, f) for t in trials for f in range(folds)]
            with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
                scores = list(ex.map(score, jobs))
        else:
            scores = [s for tree in got for s in tree]
        means = [float(np.mean([s for s in scores[i * folds: (i + 1) * folds] if s is not None])) for i in range(len(trials))]
        best = int(np.argmax(means))
        return trials[best], means[best], make_estimator(key, {**(params or {}), **trials[best]}).fit(data)
    finally:
        data.unpersist()


def search_space(defaults: dict, bounds: dict | None = None) -> dict:
    """Each numeric param -> {default/2, default, default*2} clipped to bounds; choices all."""
    bounds = bounds or {}
    out = {}
    for k, v in defaults.items():
        if isinstance(v, bool) or v is None:
            out[k] = [v]
        elif isinstance(v, (list, tuple)):
            out[k] = list(v)
        elif isinstance(v, (int, float)):
            lo, hi = bounds.get(k, (None, None))
            cand = sorted({v / 2 if isinstance(v, float) else max(1, v // 2), v, v * 2})
            cand = {v, *(c_ if lo is None else max(lo, c_) for c_ in cand if c_ < v),
                    *(c_ if hi is None else min(hi, c_) for c_ in cand if c_ > v)}
            out[k] = sorted(type(v)(c_) for c_ in cand)
        else:
            out[k] = [v]
    return out


def grid_search(prep: Prepared, estimator, grid: dict, evaluator, folds: int = 3, parallelism: int = 4,
                seed: int = 42):
    """T7 + T10: k-fold CV with a hash fold column (deterministic), refit on the best params."""
    pg = ParamGridBuilder()
    for param, values in grid.items():
        pg = pg.addGrid(estimator.getParam(param), values)
    data = prep.data.where(F.col("split") == "train").withColumn(
        "__fold", (hash_bucket(prep.keys, seed + 1, folds)).cast("int"))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=pg.build(), evaluator=evaluator,
                        foldCol="__fold", parallelism=parallelism, seed=seed)
    m = cv.fit(data)
    best = int(np.argmax(m.avgMetrics) if evaluator.isLargerBetter() else np.argmin(m.avgMetrics))
    return m.bestModel, m.avgMetrics[best], m.getEstimatorParamMaps()[best]


def random_search(prep: Prepared, estimator, ranges: dict, evaluator, n_iter: int = 25, folds: int = 3,
                  seed: int = 42, integer=()):
    """Seeded uniform draws within [min, max] (at most 25 / 50 trials), evaluated by CV."""
    rng = np.random.default_rng(seed)
    maps = []
    for _ in range(n_iter):
        m = {}
        for k, (lo, hi) in ranges.items():
            v = rng.uniform(lo, hi)
            m[estimator.getParam(k)] = int(round(v)) if k in integer else float(v)
        maps.append(m)
    data = prep.data.where(F.col("split") == "train").withColumn(
        "__fold", (hash_bucket(prep.keys, seed + 1, folds)).cast("int"))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, foldCol="__fold",
                        seed=seed)
    cvm = cv.fit(data)
    best = int(np.argmax(cvm.avgMetrics) if evaluator.isLargerBetter() else np.argmin(cvm.avgMetrics))
    return cvm.bestModel, cvm.avgMetrics[best], maps[best]


def feature_importance(model, features) -> list[tuple]:
    """Q8: tree importances or |coefficients| by feature name (one small vector from the model)."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    elif hasattr(model, "coef"):
        v = np.abs(model.coef)
    else:
        return []
    return [(f, float(x)) for f, x in zip(features, v)]


def save_model(model, spark, path: str | None = None) -> tuple[str, int]:
    """Write the fitted model (default: under the shared checkpoint folder).

    Returns (path, bytes).
    """
    from tabsmith.session import checkpoint_dir
    if path is None:
        path = os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)
    model.write().overwrite().save(path)
    # whatever file system the path names
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, files.getContentSummary(where).getLength()


def load_model(spark, path: str):
    """The model that :func:`save_model` wrote, in this or a later session."""
    from pyspark.ml.util import DefaultParamsReader
    return DefaultParamsReader.loadParamsInstance(path, spark)
