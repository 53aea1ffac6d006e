"""Evaluation metrics (V1-V25) as aggregates over a prediction table.

Input: a DataFrame with ``label``, ``prediction`` and optionally a score /
probability column, plus any grouping columns (typically ``model``), so
many models are scored by one job.  Class metrics go through the confusion
counts ``groupBy(group, label, prediction)`` -- at most groups x classes^2
rows -- and rank metrics (AUC, ROC / PR curves) through the distributed
prefix sum over distinct scores, never a single-task window over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.stats import prefix_sum

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clipping)


def _g(group):
    return list(group or [])


def confusion(df: DataFrame, label="label", prediction="prediction", group=("model",)) -> DataFrame:
    """Non-zero cells ``(group..., label, prediction, count)``."""
    g = [x for x in _g(group) if x in df.columns]
    return df.groupBy(*g, F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, label="label", prediction="prediction",
                           group=("model",)) -> DataFrame:
    """V1-V6: accuracy, weighted precision / recall / F1 (zero_division 0), Cohen's kappa, MCC.

    MCC is null when more than two true classes exist (the reference returns NaN).
    """
    g = [x for x in _g(group) if x in df.columns]
    cm = confusion(df, label, prediction, g)
    per_true = cm.groupBy(*g, F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    per_pred = cm.groupBy(*g, F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    tp = cm.where(F.col("label") == F.col("prediction")).select(*g, F.col("label").alias("cls"),
                                                                 F.col("count").alias("tp"))
    cls = per_true.join(per_pred, [*g, "cls"], "full").join(tp, [*g, "cls"], "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    cls = cls.withColumn("p", prec).withColumn("r", rec)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))) \
        .otherwise(F.lit(0.0))
    n = F.sum("support")
    agg = cls.groupBy(*g).agg(
        n.cast("double").alias("n"),
        F.sum("tp").cast("double").alias("correct"),
        F.sum(F.col("p") * F.col("support")).alias("wp"),
        F.sum(F.col("r") * F.col("support")).alias("wr"),
        F.sum(f1 * F.col("support")).alias("wf"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"),
        F.count_if(F.col("support") > 0).alias("n_true_classes"))
    s, c = F.col("n"), F.col("correct")
    pe = F.col("pt") / (s * s)
    po = c / s
    mcc_den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(F.col("n_true_classes") > 2, F.lit(None).cast("double")) \
        .when(mcc_den == 0, F.lit(0.0)).otherwise((c * s - F.col("pt")) / mcc_den)
    return agg.select(*g, (c / s).alias("accuracy"), (F.col("wp") / s).alias("precision"),
                      (F.col("wr") / s).alias("recall"), (F.col("wf") / s).alias("f1_score"),
                      F.when(pe == 1, F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe)).alias("cohen_kappa"),
                      mcc.alias("matthews_corr"))


def _score_counts(df, positive, score, group):
    """(group, score, pos, neg) over distinct scores -- partial aggregation per task."""
    return df.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).cast("double").alias("pos"), F.count_if(~positive).cast("double").alias("neg"))


def roc_auc(df: DataFrame, positive, score="score", group=("model",)) -> DataFrame:
    """V7: binary ROC AUC with tied scores counted half (rank-sum / Mann-Whitney form).

    ``positive`` is a boolean Column (label == positive class).
    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N).
    """
    g = [x for x in _g(group) if x in df.columns]
    sc = _score_counts(df, positive, score, g)
    ranked = prefix_sum(sc, g, "score", "neg", out="neg_below")
    return ranked.groupBy(*g).agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")))
        .alias("roc_auc"))


def roc_auc_ovr_weighted(df: DataFrame, label="label", probs="probability", classes=None,
                         group=("model",)) -> DataFrame:
    """V8: one-vs-rest AUC per class on the class probability, weighted by prevalence.

    ``probs`` is an array column aligned with the sorted ``classes``.
    """
    g = [x for x in _g(group) if x in df.columns]
    cl = F.array(*[F.lit(x) for x in classes])
    ex = df.select(*g, F.col(label).alias("__label"),
                   F.posexplode(F.col(probs)).alias("__k", "__p")) \
        .withColumn("__cls", F.element_at(cl, F.col("__k") + 1))
    per = roc_auc(ex, F.col("__label") == F.col("__cls"), "__p", [*g, "__cls"])
    prev = ex.groupBy(*g, "__cls").agg(F.count_if(F.col("__label") == F.col("__cls")).alias("__w"))
    return per.join(prev, [*g, "__cls"]).groupBy(*g).agg(
        (F.sum(F.col("roc_auc") * F.col("__w")) / F.sum("__w")).alias("roc_auc"))


def log_loss(df: DataFrame, p_true, group=("model",)) -> DataFrame:
    """V9: mean -ln(clip(p of the true class, eps, 1-eps))."""
    g = [x for x in _g(group) if x in df.columns]
    p = F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1 - EPS))
    return df.groupBy(*g).agg((-F.avg(F.log(p))).alias("log_loss"))


def regression_metrics(df: DataFrame, label="label", prediction="prediction", group=("model",),
                       n_features: int | None = None) -> DataFrame:
    """Rmse, mae, r2, explained_variance, adj_r2, mape (no zero target), msle (all >= 0)."""
    g = [x for x in _g(group) if x in df.columns]
    y, yh = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - yh
    a = df.groupBy(*g).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"),
        F.count_if(y == 0).alias("zeros"), F.avg(F.abs(e) / F.abs(y)).alias("mape_raw"),
        F.count_if((y < 0) | (yh < 0)).alias("negs"),
        F.avg(F.pow(F.log1p(y) - F.log1p(yh), 2)).alias("msle_raw"))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")) \
        .otherwise(F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    ev = F.when(F.col("vy") > 0, 1 - F.col("ve") / F.col("vy")) \
        .otherwise(F.when(F.col("ve") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    cols = [*g, F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2"), ev.alias("explained_variance")]
    if n_features is not None:
        p = float(n_features)
        cols.append(F.when(F.col("n") > p + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - p - 1))
                    .alias("adj_r2"))
    cols += [F.when(F.col("zeros") == 0, F.col("mape_raw")).alias("mape"),
             F.when(F.col("negs") == 0, F.col("msle_raw")).alias("msle")]
    return a.select(*cols)


def residual_summary(df: DataFrame, label="label", prediction="prediction", group=("model",)) -> DataFrame:
    """Mean and population std of residuals."""
    g = [x for x in _g(group) if x in df.columns]
    r = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*g).agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"))


def per_sample_loss(df: DataFrame, task: str, label="label", prediction="prediction") -> Column:  # noqa: F821
    """0/1 loss (classification) or squared error (regression) as a column."""
    if task == "classification":
        return (F.col(label) != F.col(prediction)).cast("double")
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    return e * e


def curve_points(df: DataFrame, positive, score="score", group=("model",)) -> DataFrame:
    """One point per distinct score threshold (descending): tpr, fpr, precision, recall.

    All thresholds are returned (the reference's library drops collinear
    ROC points); thinning is a filter on this table.
    """
    g = [x for x in _g(group) if x in df.columns]
    sc = _score_counts(df, positive, score, g)
    r = prefix_sum(prefix_sum(sc, g, "score", "pos", out="pos_below"), g, "score", "neg", out="neg_below")
    # totals: one row per group (model) -> literal lookup maps, no join (group keys may be constants)
    key = F.concat_ws("\u0001", *[F.col(x).cast("string") for x in g]) if g else F.lit("")
    tot = sc.groupBy(key.alias("__k")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()
    pm = F.create_map(*[v for r in tot for v in (F.lit(r["__k"]), F.lit(float(r["P"])))])
    nm = F.create_map(*[v for r in tot for v in (F.lit(r["__k"]), F.lit(float(r["N"])))])
    j = r.select("*", F.element_at(pm, key).alias("P"), F.element_at(nm, key).alias("N"))
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return j.select(*g, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    (tp / F.col("P")).alias("tpr"), (fp / F.col("N")).alias("fpr"),
                    (tp / (tp + fp)).alias("precision"), (tp / F.col("P")).alias("recall"))


# ------------------------------------------------------------------ clustering

def cluster_counts(df: DataFrame, cluster="cluster", group=()) -> DataFrame:
    """Size per cluster and noise flag (-1)."""
    g = _g(group)
    return df.groupBy(*g, F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size")) \
        .withColumn("is_noise", F.col("cluster") == -1)


def _centroids(df, feats, cluster, g):
    return df.groupBy(*g, F.col(cluster).alias("__c")).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), *[F.avg(x).alias(f"__m{i}") for i, x in enumerate(feats)])


def calinski_harabasz(df: DataFrame, feats, cluster="cluster", group=()) -> DataFrame:
    """(B / (k-1)) / (W / (n-k)); noise label -1 excluded.

    B from the per-cluster centroids and sizes, W from each row's squared
    distance to its centroid (centroids joined on the cluster key).
    """
    g = _g(group)
    d = df.where(F.col(cluster) != -1)
    cen = _centroids(d, feats, cluster, g)
    dj = d.join(cen.withColumnRenamed("__c", cluster), [*g, cluster])
    within = dj.groupBy(*g).agg(F.sum(sum(((F.col(x) - F.col(f"__m{i}")) ** 2 for i, x in enumerate(feats)),
                                          F.lit(0.0))).alias("W"))
    # overall mean = size-weighted mean of the centroids, so B needs only the centroid table
    wsum = [F.sum(F.col("__n") * F.col(f"__m{i}")) for i in range(len(feats))]
    tot = cen.groupBy(*g).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"),
                              *[(w_ / F.sum("__n")).alias(f"__o{i}") for i, w_ in enumerate(wsum)],
                              F.sum(F.col("__n") * sum((F.col(f"__m{i}") ** 2 for i in range(len(feats))), F.lit(0.0)))
                              .alias("__s2"))
    # B = sum_k n_k |m_k|^2 - n |o|^2
    between = tot.select(*g, "n", "k", (F.col("__s2") - F.col("n") * sum((F.col(f"__o{i}") ** 2
                                                                          for i in range(len(feats))), F.lit(0.0)))
                         .alias("B"))
    if g:
        out = between.join(within, g)
    else:
        w = within.first()["W"]
        out = between.select("*", F.lit(w).alias("W"))
    return out.select(*g, ((F.col("B") / (F.col("k") - 1)) / (F.col("W") / (F.col("n") - F.col("k"))))
                      .alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, feats, cluster="cluster") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); noise excluded.

    The k x k centroid comparison runs over k centroid rows gathered as one
    array (k = number of clusters, bounded by the model), not a row join.
    """
    d = df.where(F.col(cluster) != -1)
    cen = _centroids(d, feats, cluster, [])
    dj = d.join(cen, d[cluster] == cen["__c"])
    dist = F.sqrt(sum(((F.col(x) - F.col(f"__m{i}")) ** 2 for i, x in enumerate(feats)), F.lit(0.0)))
    s = dj.groupBy("__c", *[f"__m{i}" for i in range(len(feats))]).agg(F.avg(dist).alias("__s"))
    arr = s.agg(F.collect_list(F.struct("__c", "__s", F.array(*[F.col(f"__m{i}") for i in range(len(feats))])
                                        .alias("m"))).alias("cs"))
    ratio = F.expr("""aggregate(cs, 0D, (acc, a) -> acc + array_max(transform(filter(cs, b -> b.__c != a.__c),
        b -> (a.__s + b.__s) / sqrt(aggregate(zip_with(a.m, b.m, (u, v) -> (u - v) * (u - v)), 0D, (x, y) -> x + y)))))
        / size(cs)""")
    return arr.select(ratio.alias("davies_bouldin"))


def silhouette_sq(df: DataFrame, features_col="features", cluster="cluster") -> float:
    """V19 (re-aimed): Spark's ClusteringEvaluator silhouette, squared Euclidean, O(n k).

    The exact Euclidean silhouette needs all row pairs; it is not built.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol=cluster,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return ev.evaluate(df.where(F.col(cluster) != -1).withColumn(cluster, F.col(cluster).cast("double")))
