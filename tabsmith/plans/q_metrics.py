"""Metric and comparison queries (V*, Q*, W4-W8) with DuckDB oracles.

The "models" are SQL scoring rules (FIXTURES.md), so every metric has an
oracle without training anything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.columns import hash_bucket, hash_bucket_sql
from tabsmith.operators import compare as CMP
from tabsmith.operators import metrics as M
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import (BINARY_PRED_SQL, CLUSTERS_SQL, LABELS_PRED_SQL, MULTI_PRED_SQL, PRIORITIES,
                                     REG_PRED_SQL, binary_pred, clusters, labels_pred, multi_pred, reg_pred)

CLF = ["accuracy", "precision", "recall", "f1_score", "cohen_kappa", "matthews_corr"]


def _clf_sql(src):
    return f"""WITH p AS (SELECT 'rule' AS model, label, prediction FROM {src}),
 cm AS (SELECT label, prediction, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2),
 pt AS (SELECT label AS cls, sum(c) AS support FROM cm GROUP BY 1),
 pp AS (SELECT prediction AS cls, sum(c) AS predicted FROM cm GROUP BY 1),
 tp AS (SELECT label AS cls, c AS tp FROM cm WHERE label = prediction),
 k AS (SELECT coalesce(pt.cls, pp.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
       FROM pt FULL JOIN pp ON pt.cls = pp.cls),
 kk AS (SELECT k.*, coalesce(tp.tp, 0) AS tp FROM k LEFT JOIN tp ON k.cls = tp.cls),
 m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM kk),
 a AS (SELECT sum(support) AS n, sum(tp) AS c, sum(pr * support) AS wp, sum(re * support) AS wr,
              sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) AS wf,
              sum(support * predicted) AS pt, sum(predicted * predicted) AS pp2, sum(support * support) AS tt,
              count(*) FILTER (WHERE support > 0) AS ntc FROM m)
SELECT 'rule' AS model, round(c / n, 6) AS accuracy, round(wp / n, 6) AS precision, round(wr / n, 6) AS recall,
  round(wf / n, 6) AS f1_score,
  round(CASE WHEN pt / (n * n) = 1 THEN NULL ELSE (c / n - pt / (n * n)) / (1 - pt / (n * n)) END, 6) AS cohen_kappa,
  round(CASE WHEN ntc > 2 THEN NULL WHEN sqrt((n * n - pp2) * (n * n - tt)) = 0 THEN 0
             ELSE (c * n - pt) / sqrt((n * n - pp2) * (n * n - tt)) END, 6) AS matthews_corr
FROM a"""


def _clf_q(fixture):
    def q(spark, sf):
        df = fixture(spark, sf).withColumn("model", F.lit("rule"))
        return rnd(M.classification_metrics(df), {x: 6 for x in CLF})
    return q


register("metric_binary_classification", _clf_sql(BINARY_PRED_SQL))(_clf_q(binary_pred))
register("metric_multiclass_classification", _clf_sql(MULTI_PRED_SQL))(_clf_q(multi_pred))
register("metric_labels_classification", _clf_sql(LABELS_PRED_SQL))(_clf_q(labels_pred))


@register("confusion_matrix_multiclass", f"""SELECT 'rule' AS model, label, prediction, count(*) AS count
FROM {MULTI_PRED_SQL} GROUP BY ALL""")
def q_confusion(spark, sf):
    return M.confusion(multi_pred(spark, sf).withColumn("model", F.lit("rule")))


def _auc_sql(src, pos, score, extra_group=""):
    g = f"{extra_group}, " if extra_group else ""
    return f"""(SELECT {g}sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
  SELECT {g}pos, neg, coalesce(sum(neg) OVER (PARTITION BY {extra_group or "1"} ORDER BY score
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT {g}{score} AS score, count(*) FILTER (WHERE {pos})::DOUBLE AS pos,
               count(*) FILTER (WHERE NOT ({pos}))::DOUBLE AS neg FROM {src} GROUP BY ALL)) GROUP BY ALL)"""


@register("metric_roc_auc_binary", "SELECT 'rule' AS model, round(roc_auc, 6) AS roc_auc FROM " +
          _auc_sql(BINARY_PRED_SQL, "label = 1", "score"))
def q_auc(spark, sf):
    df = binary_pred(spark, sf).withColumn("model", F.lit("rule"))
    return rnd(M.roc_auc(df, F.col("label") == 1, "score"), {"roc_auc": 6})


def _multi_prob():
    probs = ", ".join(f"CASE WHEN o_orderkey % 5 = {k} THEN 0.6 ELSE 0.1 END" for k in range(5))
    return f"(SELECT *, [{probs}] AS probability FROM {MULTI_PRED_SQL})"


def _auc_ovr_sql():
    ex = (f"(SELECT label, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][k + 1] AS cls, "
          f"probability[k + 1] AS p FROM {_multi_prob()}, (SELECT unnest(range(5)) AS k))")
    per = _auc_sql(ex, "label = cls", "p", "cls")
    return f"""SELECT 'rule' AS model, round(sum(a.roc_auc * w.w) / sum(w.w), 6) AS roc_auc
FROM {per} a JOIN (SELECT cls, count(*) FILTER (WHERE label = cls) AS w FROM {ex} GROUP BY cls) w USING (cls)"""


@register("metric_roc_auc_ovr_weighted", _auc_ovr_sql())
def q_auc_ovr(spark, sf):
    df = multi_pred(spark, sf).withColumn("model", F.lit("rule"))
    prob = F.array(*[F.when((F.col("o_orderkey") % 5) == k, F.lit(0.6)).otherwise(F.lit(0.1)) for k in range(5)])
    df = df.withColumn("probability", prob)
    return rnd(M.roc_auc_ovr_weighted(df, classes=PRIORITIES), {"roc_auc": 6})


@register("metric_log_loss", f"""SELECT 'rule' AS model,
  round(-avg(ln(least(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 2.220446049250313e-16),
                1 - 2.220446049250313e-16))), 6) AS log_loss FROM {BINARY_PRED_SQL}""")
def q_log_loss(spark, sf):
    df = binary_pred(spark, sf).withColumn("model", F.lit("rule"))
    p_true = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    return rnd(M.log_loss(df, p_true), {"log_loss": 6})


REG = ["rmse", "mae", "r2", "explained_variance", "adj_r2", "mape", "msle"]


@register("metric_regression", f"""SELECT model,
  round(sqrt(avg((label - prediction) ^ 2)), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae,
  round(1 - avg((label - prediction) ^ 2) / var_pop(label), 6) AS r2,
  round(1 - var_pop(label - prediction) / var_pop(label), 6) AS explained_variance,
  round(1 - (avg((label - prediction) ^ 2) / var_pop(label)) * (count(*) - 1) / (count(*) - 2 - 1), 6) AS adj_r2,
  round(CASE WHEN count(*) FILTER (WHERE label = 0) = 0 THEN avg(abs(label - prediction) / abs(label)) END, 6) AS mape,
  round(CASE WHEN count(*) FILTER (WHERE label < 0 OR prediction < 0) = 0
             THEN avg((ln(1 + label) - ln(1 + prediction)) ^ 2) END, 6) AS msle
FROM {REG_PRED_SQL} GROUP BY model""")
def q_regression(spark, sf):
    m = M.regression_metrics(reg_pred(spark, sf), n_features=2)
    return rnd(m, {"rmse": 4, "mae": 4, "r2": 6, "explained_variance": 6, "adj_r2": 6, "mape": 6, "msle": 6})


@register("residual_summary", f"""SELECT model, round(avg(label - prediction), 4) AS residual_mean,
  round(stddev_pop(label - prediction), 4) AS residual_std FROM {REG_PRED_SQL} GROUP BY model""")
def q_residuals(spark, sf):
    return rnd(M.residual_summary(reg_pred(spark, sf)), {"residual_mean": 4, "residual_std": 4})


@register("roc_pr_curve", f"""WITH s AS (SELECT score, count(*) FILTER (WHERE label = 1)::DOUBLE AS pos,
    count(*) FILTER (WHERE label <> 1)::DOUBLE AS neg FROM {BINARY_PRED_SQL} GROUP BY score),
 c AS (SELECT score, sum(pos) OVER () - coalesce(sum(pos) OVER w, 0) AS tp,
              sum(neg) OVER () - coalesce(sum(neg) OVER w, 0) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
       FROM s WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'rule' AS model, round(score, 6) AS threshold, tp, fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr,
  round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM c""")
def q_curves(spark, sf):
    df = binary_pred(spark, sf).withColumn("model", F.lit("rule"))
    cp = M.curve_points(df, F.col("label") == 1, "score")
    return rnd(cp, {"threshold": 6, "tpr": 6, "fpr": 6, "precision": 6, "recall": 6})


@register("cluster_counts", f"SELECT cluster, count(*) AS size, cluster = -1 AS is_noise FROM {CLUSTERS_SQL} GROUP BY 1")
def q_cluster_counts(spark, sf):
    return M.cluster_counts(clusters(spark, sf))


@register("cluster_calinski_harabasz", f"""WITH d AS (SELECT * FROM {CLUSTERS_SQL} WHERE cluster <> -1),
 c AS (SELECT cluster, count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2 FROM d GROUP BY 1),
 o AS (SELECT avg(x1) AS o1, avg(x2) AS o2, count(*)::DOUBLE AS n FROM d),
 b AS (SELECT sum(c.n * ((m1 - o1) ^ 2 + (m2 - o2) ^ 2)) AS B, count(*)::DOUBLE AS k FROM c, o),
 w AS (SELECT sum((x1 - m1) ^ 2 + (x2 - m2) ^ 2) AS W FROM d JOIN c USING (cluster))
SELECT round((B / (k - 1)) / (W / (o.n - k)), 4) AS calinski_harabasz FROM b, w, o""")
def q_ch(spark, sf):
    return rnd(M.calinski_harabasz(clusters(spark, sf), ["x1", "x2"]), {"calinski_harabasz": 4})


@register("cluster_davies_bouldin", f"""WITH d AS (SELECT * FROM {CLUSTERS_SQL} WHERE cluster <> -1),
 c AS (SELECT cluster, avg(x1) AS m1, avg(x2) AS m2 FROM d GROUP BY 1),
 s AS (SELECT cluster, m1, m2, avg(sqrt((x1 - m1) ^ 2 + (x2 - m2) ^ 2)) AS s FROM d JOIN c USING (cluster) GROUP BY ALL),
 r AS (SELECT a.cluster, max((a.s + b.s) / sqrt((a.m1 - b.m1) ^ 2 + (a.m2 - b.m2) ^ 2)) AS r
       FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def q_db(spark, sf):
    return rnd(M.davies_bouldin(clusters(spark, sf), ["x1", "x2"]), {"davies_bouldin": 6})


# ------------------------------------------------------------------ comparison

def _reg_long(spark, sf):
    m = M.regression_metrics(reg_pred(spark, sf), n_features=2)
    return CMP.to_long(m, REG)


@register("compare_table", f"""SELECT model, round(sqrt(avg((label - prediction) ^ 2)), 4) AS rmse,
  round(avg(abs(label - prediction)), 4) AS mae, round(1 - avg((label - prediction) ^ 2) / var_pop(label), 6) AS r2
FROM {REG_PRED_SQL} GROUP BY model""")
def q_compare(spark, sf):
    t = CMP.comparison_table(_reg_long(spark, sf), ["rmse", "mae", "r2"])
    return rnd(t, {"rmse": 4, "mae": 4, "r2": 6})


@register("best_model_rmse", f"""SELECT model, 'rmse' AS metric, round(rmse, 4) AS value FROM (
  SELECT model, sqrt(avg((label - prediction) ^ 2)) AS rmse FROM {REG_PRED_SQL} GROUP BY model)
ORDER BY rmse, model LIMIT 1""")
def q_best(spark, sf):
    return rnd(CMP.best_model(_reg_long(spark, sf), "rmse"), {"value": 4})


@register("metric_normalised", f"""WITH l AS (
  SELECT model, 'rmse' AS metric, sqrt(avg((label - prediction) ^ 2)) AS value FROM {REG_PRED_SQL} GROUP BY model
  UNION ALL SELECT model, 'mae', avg(abs(label - prediction)) FROM {REG_PRED_SQL} GROUP BY model)
SELECT model, metric, round(value, 4) AS value,
  round((value - min(value) OVER (PARTITION BY metric)) / CASE WHEN max(value) OVER (PARTITION BY metric)
        - min(value) OVER (PARTITION BY metric) = 0 THEN 1 ELSE max(value) OVER (PARTITION BY metric)
        - min(value) OVER (PARTITION BY metric) END, 6) AS norm FROM l""")
def q_norm(spark, sf):
    long = _reg_long(spark, sf).where(F.col("metric").isin("rmse", "mae"))
    return rnd(CMP.normalise_metrics(long), {"value": 4, "norm": 6})


def _reg_losses(spark, sf):
    """Per-sample squared losses of both rule models, paired by a 128-bit row key.

    lineitem has no duplicate rows, so two independent 64-bit hashes of the whole
    row (xxhash64 + murmur3) identify it (collision odds ~ n^2 / 2^129); no positions needed.
    """
    from tabsmith.plans.fixtures import table
    li = table(spark, sf, "lineitem")
    rid = F.struct(F.xxhash64(*li.columns).alias("h1"), F.hash(*li.columns).alias("h2"))
    y = F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.1
    m1 = li.select(rid.alias("row_id"), F.lit("m1").alias("model"),
                   F.pow(y - (F.col("l_quantity") * 1000 + 5250), 2).alias("loss"))
    m2 = li.select(rid.alias("row_id"), F.lit("m2").alias("model"),
                   F.pow(y - (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.09), 2).alias("loss"))
    return m1.unionByName(m2)


@register("paired_ttest", """WITH d AS (SELECT
    (l_extendedprice * 0.1 - 5250) ^ 2 - (l_extendedprice * 0.1 - l_extendedprice * 0.09) ^ 2 AS d FROM lineitem)
SELECT 'm1' AS model, 'm2' AS baseline, count(*) AS n, round(avg(d), 4) AS mean_diff,
  round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM d""")
def q_ttest(spark, sf):
    t = CMP.paired_ttest(_reg_losses(spark, sf), "m2")
    return rnd(t.select("model", "baseline", "n", "mean_diff", "t"), {"mean_diff": 4, "t": 4})


@register("paired_ttest_pvalues", """WITH d AS (SELECT
    (l_extendedprice * 0.1 - 5250) ^ 2 - (l_extendedprice * 0.1 - l_extendedprice * 0.09) ^ 2 AS d FROM lineitem),
 t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS nu FROM d),
 -- x = sqrt(nu) tan(a): the density becomes cos(a)^(nu - 1); midpoints over a quarter turn
 a AS (SELECT (i + 0.5) * pi() / 2 / 40000 AS a FROM (SELECT unnest(range(40000)) AS i)),
 p AS (SELECT sum(CASE WHEN a > atan(abs(t) / sqrt(nu)) THEN exp((nu - 1) * ln(cos(a))) ELSE 0 END)
              / sum(exp((nu - 1) * ln(cos(a)))) AS p FROM a, t)
SELECT 'm1' AS model, round(p, 4) AS p, round(least(1.0, p * 1), 4) AS p_bonferroni, least(1.0, p * 1) < 0.05 AS significant FROM p""")
def q_ttest_p(spark, sf):
    """Q4 p-value (Student's t) + Q5 Bonferroni flag."""
    t = CMP.paired_ttest(_reg_losses(spark, sf), "m2")
    return rnd(t.select("model", "p", "p_bonferroni", "significant"), {"p": 4, "p_bonferroni": 4})


_ROW_ID = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@register("bootstrap_ci", f"""WITH l AS (SELECT 'm1' AS model, (l_extendedprice * 0.1 - 5250) ^ 2 AS loss, md5('42:' || {_ROW_ID}) AS h FROM lineitem
   UNION ALL SELECT 'm2', (l_quantity * 1000 + l_extendedprice * 0.1 - (l_quantity * 1000 + l_extendedprice * 0.09)) ^ 2, md5('42:' || {_ROW_ID}) FROM lineitem),
 d AS (SELECT model, loss, ('0x' || substr(h, 1, 8))::BIGINT % {CMP.PRIME} AS h1, ('0x' || substr(h, 9, 8))::BIGINT % {CMP.PRIME} AS h2 FROM l),
 w AS (SELECT model, b, loss, {' + '.join(f'(u > {int(p * CMP.PRIME)})::INT' for p in CMP.POISSON)} AS w
       FROM (SELECT model, loss, b, (h1 + b * h2) % {CMP.PRIME} AS u FROM d, (SELECT unnest(range(500)) AS b))),
 m AS (SELECT model, b, sum(w * loss) / sum(w) AS m FROM w GROUP BY ALL)
SELECT model, round(mean, 2) AS mean, n, round(lo, 2) AS lo, round(hi, 2) AS hi
FROM (SELECT model, avg(loss) AS mean, count(*) AS n FROM d GROUP BY 1)
JOIN (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1) USING (model)""")
def q_bootstrap(spark, sf):
    """Q6: 500-replicate Poisson bootstrap CI of each rule model's mean squared loss."""
    from tabsmith.plans.fixtures import table
    li = table(spark, sf, "lineitem")
    y = F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.1
    rid = F.concat_ws(":", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("row_id")
    losses = [li.select(rid, F.lit(m).alias("model"), F.pow(y - p, 2).alias("loss")) for m, p in
              (("m1", F.col("l_quantity") * 1000 + 5250), ("m2", F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.09))]
    return rnd(CMP.bootstrap_ci(losses[0].unionByName(losses[1]), "loss", ["model"]), {"mean": 2, "lo": 2, "hi": 2})


_SPLIT = hash_bucket_sql(["l_orderkey", "l_linenumber", "l_partkey"])


@register("overfit_gap", f"""WITH b AS (SELECT CASE WHEN {_SPLIT} < 2000 THEN 'test' ELSE 'train' END AS split,
    l_quantity * 1000 + l_extendedprice * 0.1 AS label, l_quantity, l_extendedprice FROM lineitem),
 s AS (SELECT split, label, 'm1' AS model, l_quantity * 1000 + 5250 AS prediction FROM b
       UNION ALL SELECT split, label, 'm2', l_quantity * 1000 + l_extendedprice * 0.09 FROM b),
 m AS (SELECT model, split, sqrt(avg((label - prediction) ^ 2)) AS rmse FROM s GROUP BY ALL)
SELECT model, 'rmse' AS metric, round(max(rmse) FILTER (WHERE split = 'train'), 4) AS train,
  round(max(rmse) FILTER (WHERE split = 'test'), 4) AS test,
  round(max(rmse) FILTER (WHERE split = 'train') - max(rmse) FILTER (WHERE split = 'test'), 4) AS gap
FROM m GROUP BY model""")
def q_overfit(spark, sf):
    from tabsmith.plans.fixtures import table
    li = table(spark, sf, "lineitem")
    y = F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.1
    split = F.when(hash_bucket(["l_orderkey", "l_linenumber", "l_partkey"]) < 2000, "test").otherwise("train")
    base = li.select(split.alias("split"), y.alias("label"), "l_quantity", "l_extendedprice")
    m1 = base.select("split", "label", F.lit("m1").alias("model"),
                     (F.col("l_quantity") * 1000 + 5250).alias("prediction"))
    m2 = base.select("split", "label", F.lit("m2").alias("model"),
                     (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.09).alias("prediction"))
    met = M.regression_metrics(m1.unionByName(m2), group=["model", "split"]).select("model", "split", "rmse")
    long = CMP.to_long(met, ["rmse"], key=["model", "split"])
    return rnd(CMP.overfit_gap(long), {"train": 4, "test": 4, "gap": 4})


@register("train_test_split", f"""SELECT CASE WHEN {_SPLIT} < 2000 THEN 'test' ELSE 'train' END AS split,
  count(*) AS rows FROM lineitem GROUP BY 1""")
def q_split(spark, sf):
    """Deterministic md5-bucket split, test share 0.2."""
    from tabsmith.plans.fixtures import table
    li = table(spark, sf, "lineitem")
    split = F.when(hash_bucket(["l_orderkey", "l_linenumber", "l_partkey"]) < 2000, "test").otherwise("train")
    return li.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"))
