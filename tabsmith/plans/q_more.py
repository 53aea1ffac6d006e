"""Queries of operators that had none: specs, exports, feedback, per-sample losses, casts, and closed forms of learners."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.functions import columns as COL
from tabsmith.operators import compare as CMP
from tabsmith.operators import metrics as M
from tabsmith.operators import profile as P
from tabsmith.operators.estimators import make_estimator
from tabsmith.plans import registry as REG
from tabsmith.plans import steps
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import (BINARY_PRED_SQL, CLUSTERS_SQL, EVENTS_NONFINITE_SQL, LINEITEM_NULLS_SQL, REG_PRED_SQL, binary_pred, clusters,
                                     events_nonfinite, lineitem_nulls, reg_pred, table)
from tabsmith.plans.registry import CARDS, registry_sql
from tabsmith.sources import io as IO
from tabsmith.sources import runs as RUNS


def _folder(spark, stem: str) -> str:
    from tabsmith.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/tabsmith-io/{stem}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ specs, exports, run tables

_SPEC = [{"name": "fill", "operation": "impute", "params": {"columns": ["l_quantity"], "strategy": "mean"}},
         {"name": "drop", "operation": "drop_columns", "params": {"columns": ["l_discount"]}},
         {"name": "name", "operation": "rename_columns", "params": {"mapping": {"l_tax": "tax"}}}]


@register("spec_roundtrip", f"""WITH d AS (SELECT *, coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LINEITEM_NULLS_SQL})) AS q FROM {LINEITEM_NULLS_SQL})
SELECT l_linestatus, round(sum(q), 2) AS quantity, round(avg(l_tax), 6) AS tax, count(*) AS n FROM d GROUP BY 1""")
def q_spec(spark, sf):
    """S9 + PR26: a step spec written as JSON text to the shared folder, read back and applied."""
    path = _folder(spark, "spec")
    spark.createDataFrame([(steps.dump_spec(_SPEC),)], "value string").coalesce(1).write.option("lineSep", "\n\n").text(path)
    back = spark.read.text(path, wholetext=True).first()[0]
    _, out = steps.apply(lineitem_nulls(spark, sf), steps.load_spec(back))
    assert "l_discount" not in out.columns
    return rnd(out.groupBy("l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.avg("tax").alias("tax"), F.count(F.lit(1)).alias("n")),
               {"quantity": 2, "tax": 6})


@register("impute_by_column", f"""SELECT round(avg(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LINEITEM_NULLS_SQL}))), 4) AS quantity,
  round(avg(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM {LINEITEM_NULLS_SQL}))), 4) AS price,
  count(*) FILTER (WHERE coalesce(l_returnflag, (SELECT arg_max(l_returnflag, (n, -ascii(l_returnflag))) FROM (
    SELECT l_returnflag, count(*) AS n FROM {LINEITEM_NULLS_SQL} WHERE l_returnflag IS NOT NULL GROUP BY 1))) = 'N') AS flag_n FROM {LINEITEM_NULLS_SQL}""")
def q_groups(spark, sf):
    """M5: one impute step per strategy of a per-column choice."""
    spec = steps.strategy_groups({"l_quantity": "mean", "l_extendedprice": "median", "l_returnflag": "most_frequent"})
    _, out = steps.apply(lineitem_nulls(spark, sf), spec)
    return rnd(out.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
                       F.count_if(F.col("l_returnflag") == "N").alias("flag_n")), {"quantity": 4, "price": 4})


@register("step_problems", """SELECT 0 AS step, 'unknown operation' AS problem, count(*) AS rows FROM lineitem
UNION ALL SELECT 2, 'no target column', count(*) FROM lineitem""")
def q_problems(spark, sf):
    """PR24: problems of a spec against a table's columns, beside the rows that the spec would touch."""
    li = table(spark, sf, "lineitem")
    spec = [{"name": "a", "operation": "nonsense"}, {"name": "b", "operation": "rename_columns", "params": {"mapping": {"l_tax": "tax"}}},
            {"name": "c", "operation": "feature_selection", "params": {"method": "select_k_best", "target": "l_tax"}},
            {"name": "d", "operation": "feature_selection", "params": {"method": "select_k_best", "target": "tax"}}]
    found = [(int(e.split(" ")[1]), "unknown operation" if "unknown" in e else "no target column") for e in steps.validate(li, spec)]
    picks = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("problem")) for i, p in found])
    return li.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(picks), "rows")


@register("comparison_export", f"""SELECT model, round(sqrt(avg((label - prediction) ^ 2)), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae
FROM {REG_PRED_SQL} GROUP BY model""")
def q_export(spark, sf):
    """The comparison table exported as CSV and loaded again."""
    long = CMP.to_long(M.regression_metrics(reg_pred(spark, sf), n_features=2), ["rmse", "mae"])
    path = _folder(spark, "comparison") + ".csv"
    IO.export(CMP.comparison_table(long, ["rmse", "mae"]), path, "csv")
    return rnd(IO.read_csv(spark, path).select("model", "rmse", "mae"), {"rmse": 4, "mae": 4})


@register("feedback_appended", """SELECT 'u' || CAST(user_id % 3 AS VARCHAR) AS user_id, event_type AS algorithm_key, count(*) AS events,
  CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM events GROUP BY ALL""")
def q_feedback(spark, sf):
    """Feedback appended in two writes (one per half of the day), read as one table."""
    ev = table(spark, sf, "events")
    path = _folder(spark, "feedback")
    rows = ev.select(F.monotonically_increasing_id().alias("id"), COL.epoch_seconds(F.col("ts")).alias("created_at"),
                     F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("user_id"), F.col("event_type").alias("algorithm_key"),
                     F.col("event_type").isin("click", "purchase").cast("int").alias("accepted"), F.hour("ts").alias("h"))
    for half in (F.col("h") < 12, F.col("h") >= 12):
        RUNS.append_feedback_rows(rows.where(half).drop("h"), path)
    back = RUNS.read_feedback(spark, path)
    return back.groupBy("user_id", "algorithm_key").agg(F.count(F.lit(1)).alias("events"), F.sum("accepted").cast("bigint").alias("accepted"))


# ------------------------------------------------------------------ casts and losses

@register("coerce_booleans", """SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 150000 THEN 1.0 END) AS dear, count(o_totalprice > 150000) AS known FROM (
  SELECT o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders) GROUP BY 1""")
def q_bool(spark, sf):
    """a boolean column with missing cells as 0 / 1."""
    o = table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") > 150000).alias("dear"))
    num = COL.coerce_features(o, exclude=["o_orderstatus"])
    return num.groupBy("o_orderstatus").agg(F.sum(F.when(F.col("dear") == 1, 1.0)).alias("dear"), F.count("dear").alias("known"))


@register("nonfinite_dropped", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {EVENTS_NONFINITE_SQL} WHERE isfinite(value) GROUP BY 1")
def q_inf(spark, sf):
    """infinite cells become missing, rows with missing cells go."""
    out = COL.drop_nonfinite(events_nonfinite(spark, sf), ["value"])
    return rnd(out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), {"total": 4})


@register("loss_by_flag", f"""SELECT 'classification' AS task, l_tax >= 0.04 AS high_tax, round(avg(CAST(label <> prediction AS DOUBLE)), 6) AS loss FROM {BINARY_PRED_SQL} GROUP BY 2
UNION ALL SELECT 'regression', l_tax >= 0.04, round(avg((label - prediction) ^ 2), 4) FROM {REG_PRED_SQL} WHERE model = 'm2' GROUP BY 2""")
def q_losses(spark, sf):
    """Per-sample losses, averaged by a column."""
    b, r = binary_pred(spark, sf), reg_pred(spark, sf).where("model = 'm2'")
    parts = []
    for task, df, digits in (("classification", b, 6), ("regression", r, 4)):
        out = df.groupBy((F.col("l_tax") >= 0.04).alias("high_tax")).agg(F.avg(M.per_sample_loss(df, task)).alias("loss"))
        parts.append(rnd(out.select(F.lit(task).alias("task"), "high_tax", "loss"), {"loss": digits}))
    return parts[0].unionByName(parts[1])


@register("best_by_primary", f"""SELECT model, 'rmse' AS metric, round(value, 4) AS value, 'mae' AS second FROM (
  SELECT model, sqrt(avg((label - prediction) ^ 2)) AS value FROM {REG_PRED_SQL} GROUP BY model) ORDER BY value, model LIMIT 1""")
def q_primary(spark, sf):
    """Q2 + Q3: the best model by the task's primary metric, with the secondary one named."""
    first, up, second, _ = CMP.primary_metric("regression")
    long = CMP.to_long(M.regression_metrics(reg_pred(spark, sf), n_features=2), ["rmse", "mae", "r2"])
    return rnd(CMP.best_model(long, first, up).withColumn("second", F.lit(second)), {"value": 4})


@register("feature_sample_ratio", "SELECT 11 AS features, count(*) AS samples, round(11.0 / count(*), 9) AS feature_to_sample_ratio FROM lineitem")
def q_ratio(spark, sf):
    """PR27: features per sample."""
    return rnd(P.feature_sample_ratio(table(spark, sf, "lineitem")), {"feature_to_sample_ratio": 9})


# ------------------------------------------------------------------ registry over the feedback

_KEYS = "[" + ", ".join(f"'{k}'" for k, *_ in CARDS) + "]"


@register("registry_search", f"""SELECT g.key, g.name, count(*) AS events FROM events e JOIN {registry_sql()} g ON g.key = {_KEYS}[CAST(e.event_id % {len(CARDS)} + 1 AS INTEGER)]
WHERE g.task_type = 'regression' AND contains(lower(concat_ws(' ', g.key, g.name, g.task_type, g.family)), 'tree') GROUP BY ALL""")
def q_search(spark, sf):
    """cards found by task and text, with the feedback events that name them."""
    found = REG.search(REG.registry(spark), "regression", "Tree")
    ev = table(spark, sf, "events").select(F.element_at(F.array(*[F.lit(k) for k, *_ in CARDS]), (F.col("event_id") % len(CARDS) + 1).cast("int")).alias("key"))
    # the registry has 45 rows
    return ev.join(F.broadcast(found.select("key", "name")), "key").groupBy("key", "name").agg(F.count(F.lit(1)).alias("events"))


@register("factory_slope", """SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept FROM orders""")
def q_factory(spark, sf):
    """U1 + A1: an estimator made by its registry key."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("label"))
    m = REG.estimator_factory("reg_linear", {}).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(o))
    out = o.limit(1).select(F.lit(float(m.coefficients[0])).alias("slope"), F.lit(float(m.intercept)).alias("intercept"))
    return rnd(out, {"slope": 6, "intercept": 3})


# ------------------------------------------------------------------ closed forms of two features

@register("pca_variance_2d", """WITH s AS (SELECT var_pop(x1) AS a, var_pop(x2) AS c, covar_pop(x1, x2) AS b FROM
  (SELECT CAST(p_size AS DOUBLE) * 20 AS x1, p_retailprice AS x2 FROM part)),
 e AS (SELECT (a + c + sqrt((a - c) ^ 2 + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) ^ 2 + 4 * b * b)) / 2 AS l2 FROM s)
SELECT 0 AS component, round(l1 / (l1 + l2), 8) AS explained_variance_ratio FROM e UNION ALL SELECT 1, round(l2 / (l1 + l2), 8) FROM e""")
def q_pca_variance(spark, sf):
    """A30 + V23: explained variance ratios of two features against the closed form."""
    p = table(spark, sf, "part").select((F.col("p_size").cast("double") * 20).alias("x1"), F.col("p_retailprice").alias("x2"))
    m = make_estimator("dr_pca", {"n_components": 2}).fit(VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(p))
    ev = [float(v) for v in m.explainedVariance.toArray()]
    out = p.limit(1).select(F.posexplode(F.array(*[F.lit(v) for v in ev]))).toDF("component", "explained_variance_ratio")
    return rnd(out, {"explained_variance_ratio": 8})


@register("silhouette_of_clusters", f"""WITH p AS (SELECT p_partkey, x1, x2, cluster FROM {CLUSTERS_SQL} WHERE cluster <> -1),
 c AS (SELECT cluster AS other, count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x1 * x1 + x2 * x2) AS q FROM p GROUP BY 1),
 d AS (SELECT p_partkey, cluster, other, n, x1 * x1 + x2 * x2 - 2 * (x1 * m1 + x2 * m2) + q AS mean FROM p, c),
 s AS (SELECT p_partkey, max(CASE WHEN other = cluster THEN mean * n / (n - 1) END) AS a, min(CASE WHEN other <> cluster THEN mean END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_sq FROM s""")
def q_silhouette(spark, sf):
    """V19 (re-aimed): squared-Euclidean silhouette of the rule-made clusters."""
    d = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(clusters(spark, sf))
    s = M.silhouette_sq(d, "features", "cluster")
    return rnd(d.limit(1).select(F.lit(float(s)).alias("silhouette_sq")), {"silhouette_sq": 6})
