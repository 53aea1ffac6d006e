"""Recommendation and registry queries (R*, A32, F14, SC2) with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabsmith.operators import recommend as R
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import table
from tabsmith.plans.registry import CARDS, registry_sql

# (dataset_id, table, target, task, numeric columns, other columns)
DATASETS = [
    ("lineitem_flag", "lineitem", "l_returnflag", "classification",
     ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
     ["l_returnflag", "l_linestatus", "l_shipdate"]),
    ("orders_price", "orders", "o_totalprice", "regression", ["o_orderkey", "o_custkey", "o_totalprice"],
     ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    ("customer_segments", "customer", None, "clustering", ["c_custkey", "c_nationkey", "c_acctbal"],
     ["c_name", "c_mktsegment"]),
    ("part_dimred", "part", None, "dimred", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
]

# user choices per dataset (configuration, not data)
REQUIREMENTS = [
    ("lineitem_flag", "classification", "High", "Fast", "Moderate", "Small", False, False, True, 40, 25, 20, 15,
     None, "u1"),
    ("orders_price", "regression", "Medium", "Moderate", "Fast", "Medium", False, True, False, 50, 30, 10, 10,
     "Car Price", "u2"),
    ("customer_segments", "clustering", "Low", "Unlimited", "Moderate", "Medium", False, False, False,
     30, 30, 30, 30, "Segmentation", "u1"),
    ("part_dimred", "dimred", "High", "Moderate", "Moderate", "Medium", True, False, False, 10, 20, 30, 45,
     None, "u0"),
]


def _meta_all(spark, sf):
    parts = [R.meta_features(table(spark, sf, t), ds, tgt, task) for ds, t, tgt, task, _, _ in DATASETS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _req(spark):
    return spark.createDataFrame(REQUIREMENTS, R.REQ_SCHEMA)


def _feedback(spark, sf):
    """Accept / reject history derived from ``events``: event -> (user, algorithm card, accepted)."""
    ev = table(spark, sf, "events")
    keys = F.array(*[F.lit(k) for k, *_ in CARDS])
    tasks = F.array(*[F.lit(t) for _, _, t, _, _ in CARDS])
    pos = (F.col("event_id") % len(CARDS) + 1).cast("int")
    return ev.select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("user_id"),
                     F.element_at(tasks, pos).alias("task_type"), F.element_at(keys, pos).alias("algorithm_key"),
                     F.col("event_type").isin("click", "purchase").cast("int").alias("accepted"))


def _sql_lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


REQ_SQL = ("(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in REQUIREMENTS)
           + ") AS q(dataset_id, task_type, interpretability, training_time, prediction_speed, deployment_size, "
             "must_be_interpretable, must_be_fast, must_handle_categorical, w_accuracy, w_speed, w_interpretability, "
             "w_robustness, automobile_preset, user_id))")

FEEDBACK_SQL = ("(SELECT 'u' || CAST(user_id % 3 AS VARCHAR) AS user_id, "
                "[" + ", ".join(_sql_lit(t) for _, _, t, _, _ in CARDS) + f"][CAST(event_id % {len(CARDS)} + 1 AS INTEGER)]"
                " AS task_type, [" + ", ".join(_sql_lit(k) for k, *_ in CARDS) +
                f"][CAST(event_id % {len(CARDS)} + 1 AS INTEGER)] AS algorithm_key, "
                "CAST(event_type IN ('click', 'purchase') AS INTEGER) AS accepted FROM events)")

BIAS_SQL = f"""(SELECT user_id, task_type, algorithm_key,
   greatest(-6.0, least(6.0, (a - r) / greatest(1.0, CAST(a + r AS DOUBLE)) * 6)) AS bias FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, task_type ORDER BY a + r DESC, algorithm_key) AS rk FROM (
   SELECT user_id, task_type, algorithm_key, sum(CASE WHEN accepted = 1 THEN 1 ELSE 0 END) AS a,
          sum(CASE WHEN accepted = 0 THEN 1 ELSE 0 END) AS r FROM {FEEDBACK_SQL} GROUP BY ALL))
  WHERE rk <= 500 AND a + r > 0)"""


def _meta_sql(ds, tbl, tgt, task, num, other):
    cols = num + other
    feat_num = [x for x in num if x != tgt]
    feat_cat = [x for x in other if x != tgt]
    nulls = " + ".join(f"count(*) FILTER (WHERE {x} IS NULL" + (f" OR isnan({x})" if x in num else "") + ")"
                       for x in cols)
    nfeat = len(cols) - (1 if tgt else 0)
    denom = max(1, len(feat_num) + len(feat_cat))
    pairs = [(a, b) for i, a in enumerate(feat_num) for b in feat_num[i + 1:]]
    if pairs:
        cond = " AND ".join(f"{x} IS NOT NULL AND isfinite(CAST({x} AS DOUBLE))" for x in feat_num)
        rs = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r{i}" for i, (a, b) in enumerate(pairs))
        ok = [f"(r{i} IS NOT NULL AND NOT isnan(r{i}))" for i in range(len(pairs))]
        mean_abs = ("((" + " + ".join(f"CASE WHEN {o} THEN abs(r{i}) ELSE 0 END" for i, o in enumerate(ok))
                    + ") / nullif((" + " + ".join(f"CASE WHEN {o} THEN 1 ELSE 0 END" for o in ok) + "), 0))")
        high = "(" + " + ".join(f"CASE WHEN abs(r{i}) > 0.9 THEN 1 ELSE 0 END" for i in range(len(pairs))) + \
            f") / {float(len(pairs))}"
        corr = (f"(SELECT CASE WHEN n >= 20 THEN {mean_abs} END AS corr_mean_abs, "
                f"CASE WHEN n >= 20 THEN {high} END AS corr_high_pair_ratio FROM "
                f"(SELECT count(*) AS n, {rs} FROM {tbl} WHERE {cond}))")
    else:
        corr = "(SELECT CAST(NULL AS DOUBLE) AS corr_mean_abs, CAST(NULL AS DOUBLE) AS corr_high_pair_ratio)"
    ci = (f"(SELECT max(n) / sum(n) AS class_imbalance FROM (SELECT count(*) AS n FROM {tbl} GROUP BY {tgt}))"
          if tgt and task == "classification" else "(SELECT CAST(NULL AS DOUBLE) AS class_imbalance)")
    return f"""SELECT '{ds}' AS dataset_id, count(*) AS n_samples, {nfeat} AS n_features, {len(feat_num)} AS n_numeric,
  {len(feat_cat)} AS n_categorical, CAST({len(feat_num) / denom} AS DOUBLE) AS numeric_ratio, CAST({len(feat_cat) / denom} AS DOUBLE) AS categorical_ratio,
  ({nulls}) * 100.0 / (count(*) * {len(cols)}) AS missing_pct,
  (SELECT corr_mean_abs FROM {corr}) AS corr_mean_abs, (SELECT corr_high_pair_ratio FROM {corr}) AS corr_high_pair_ratio,
  (SELECT class_imbalance FROM {ci}) AS class_imbalance, CAST(NULL AS DOUBLE) AS linearity_score,
  CAST(NULL AS VARCHAR) AS noise_level FROM {tbl}"""


META_SQL = "(" + "\nUNION ALL\n".join(_meta_sql(*d) for d in DATASETS) + ")"

META_ROUND = {"numeric_ratio": 6, "categorical_ratio": 6, "missing_pct": 6, "corr_mean_abs": 6,
              "corr_high_pair_ratio": 6, "class_imbalance": 6}


@register("meta_features", "SELECT dataset_id, n_samples, n_features, n_numeric, n_categorical, " + ", ".join(
    f"round({k}, {d}) AS {k}" for k, d in META_ROUND.items()) + f" FROM {META_SQL}")
def q_meta(spark, sf):
    m = _meta_all(spark, sf)
    return rnd(m.select("dataset_id", "n_samples", "n_features", "n_numeric", "n_categorical", *META_ROUND), META_ROUND)


def _scored_sql():
    """R8-R12 written out by hand, from the rule tables and not from the library's expressions."""
    return f"""(
 WITH b(pos, pattern, accuracy, speed, interpretability, robustness) AS (VALUES
   (1, '%linear%', 65, 90, 95, 75), (2, '%svm%', 75, 55, 55, 80), (3, '%tree%', 80, 75, 70, 85), (4, '%boost%', 88, 60, 35, 80),
   (5, '%neighbors%', 70, 70, 45, 60), (5, '%knn%', 70, 70, 45, 60), (6, '%cluster%', 60, 80, 55, 60),
   (7, '%dimred%', 55, 85, 60, 60), (7, '%reduction%', 55, 85, 60, 60), (8, '%', 70, 70, 60, 70)),
 base AS (SELECT g.key, arg_min(b, b.pos) AS base FROM {registry_sql()} g JOIN b ON lower(g.family) LIKE b.pattern
          WHERE NOT (b.pattern = '%tree%' AND lower(g.family) LIKE '%boost%') GROUP BY g.key),
 c AS (SELECT m.*, q.* EXCLUDE (dataset_id), g.* EXCLUDE (task_type), base.base, coalesce(f.bias, 0) AS bump,
         lower(g.family) LIKE '%linear%' AS linear, lower(g.family) LIKE '%svm%' AS svm, lower(g.family) LIKE '%tree%' AS tree,
         lower(g.family) LIKE '%boost%' AS boost, lower(g.family) LIKE '%neighbors%' OR lower(g.family) LIKE '%knn%' AS knn,
         lower(g.name) AS low, lower(coalesce(q.interpretability, 'Medium')) = 'high' AS clear,
         g.key LIKE '%catboost%' OR g.key LIKE '%lightgbm%' AS native, lower(trim(coalesce(q.automobile_preset, ''))) AS preset
       FROM {META_SQL} m JOIN {REQ_SQL} q USING (dataset_id) JOIN {registry_sql()} g ON g.task_type = q.task_type JOIN base ON base.key = g.key
       LEFT JOIN {BIAS_SQL} f ON f.user_id = q.user_id AND f.task_type = q.task_type AND f.algorithm_key = g.key
       WHERE g.available),
 r AS (SELECT *, n_samples BETWEEN 1 AND 999 AND clear AS few,
         coalesce(class_imbalance > 0.7, false) AND task_type = 'classification' AND (low LIKE '%randomforest%' OR low LIKE '%logistic%' OR svm) AS class_weight_balanced
       FROM c),
 adj AS (SELECT *,
   base.accuracy + (few AND (linear OR low LIKE '%logistic%'))::INT * 8 - (few AND NOT (linear OR low LIKE '%logistic%'))::INT * 5
     + (n_features > 100 AND n_samples > 10000 AND (tree OR boost))::INT * 6 + (n_categorical > 10 AND native)::INT * 10
     + (coalesce(linearity_score >= 0.7, false) AND linear)::INT * 6 + (coalesce(linearity_score < 0.4, false) AND (boost OR tree))::INT * 6
     + (contains(preset, 'car price') AND (key LIKE '%xgboost%' OR key LIKE '%lightgbm%' OR low LIKE '%random forest%'))::INT * 8
     + (contains(preset, 'fuel') AND (low LIKE '%gradient%' OR linear))::INT * 6
     + (contains(preset, 'segmentation') AND task_type = 'clustering' AND (key LIKE '%kmeans%' OR key LIKE '%dbscan%'))::INT * 6 AS a,
   base.speed + (n_categorical > 10 AND native)::INT * 3 - (lower(coalesce(training_time, 'Moderate')) = 'fast' AND (boost OR svm))::INT * 10
     + (lower(coalesce(training_time, 'Moderate')) = 'fast' AND linear)::INT * 6 - (lower(coalesce(prediction_speed, 'Moderate')) = 'fast' AND knn)::INT * 10
     - (lower(coalesce(deployment_size, 'Medium')) = 'small' AND (boost OR low LIKE '%forest%'))::INT * 3 AS s,
   base.interpretability + (few AND (linear OR low LIKE '%logistic%'))::INT * 5 - (clear AND (boost OR key LIKE '%xgboost%'))::INT * 20
     + (clear AND linear)::INT * 5 AS i,
   base.robustness + class_weight_balanced::INT * 8 + (coalesce(noise_level = 'High', false) AND (low LIKE '%ridge%' OR svm OR tree))::INT * 8
     + (coalesce(corr_high_pair_ratio > 0.05, false) AND (low LIKE '%ridge%' OR low LIKE '%lasso%' OR linear))::INT * 6 AS o,
   greatest(1, w_accuracy + w_speed + w_interpretability + w_robustness) AS w FROM r),
 done AS (SELECT * EXCLUDE (interpretability), CAST(greatest(0, least(100, a)) AS INTEGER) AS accuracy_score, CAST(greatest(0, least(100, s)) AS INTEGER) AS speed_score,
   CAST(greatest(0, least(100, i)) AS INTEGER) AS interpretability_score, CAST(greatest(0, least(100, o)) AS INTEGER) AS robustness_score FROM adj)
 SELECT *, CAST(round_even(greatest(0, least(100, (accuracy_score * round_even(w_accuracy * 100.0 / w, 0) + speed_score * round_even(w_speed * 100.0 / w, 0)
     + interpretability_score * round_even(w_interpretability * 100.0 / w, 0) + robustness_score * round_even(w_robustness * 100.0 / w, 0)) / 100.0 + bump)), 0) AS INTEGER) AS score_total
 FROM done
 WHERE (NOT must_be_interpretable OR interpretability_score >= 60) AND (NOT must_be_fast OR speed_score >= 60)
   AND (NOT must_handle_categorical OR n_categorical = 0 OR native OR family IN ('Tree-based', 'Boosting', 'Linear')))"""


@register("recommend_scores", f"""SELECT dataset_id, key AS algorithm_key, accuracy_score, speed_score,
  interpretability_score, robustness_score, score_total FROM {_scored_sql()}""")
def q_scores(spark, sf):
    s = R.score_candidates(_meta_all(spark, sf), _req(spark), R.feedback_bias(_feedback(spark, sf)))
    return s.select("dataset_id", F.col("key").alias("algorithm_key"), "accuracy_score", "speed_score",
                    "interpretability_score", "robustness_score", "score_total")


@register("recommend_top5", f"""SELECT dataset_id, rank, key AS algorithm_key, name AS model_name, family,
  accuracy_score, speed_score, interpretability_score, robustness_score, score_total, class_weight_balanced FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score_total DESC, position) AS rank
  FROM {_scored_sql()}) WHERE rank <= 5""")
def q_top5(spark, sf):
    top = R.recommend_top(_meta_all(spark, sf), _req(spark), R.feedback_bias(_feedback(spark, sf)))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@register("recommender_feedback_bias", f"SELECT user_id, task_type, algorithm_key, round(bias, 6) AS bias FROM {BIAS_SQL}")
def q_bias(spark, sf):
    return rnd(R.feedback_bias(_feedback(spark, sf)), {"bias": 6})


@register("recommend_suggestions", f"""WITH t AS (SELECT dataset_id, count(*) AS n_top, bool_or(family IN ('Linear', 'Boosting')) AS stack FROM (
   SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score_total DESC, position) AS rank FROM {_scored_sql()}) WHERE rank <= 5 GROUP BY 1),
 j AS (SELECT m.*, q.* EXCLUDE (dataset_id), t.n_top, t.stack, q.task_type IN ('classification', 'regression') AS sup
       FROM {META_SQL} m JOIN {REQ_SQL} q USING (dataset_id) LEFT JOIN t USING (dataset_id))
SELECT dataset_id, concat_ws(',', CASE WHEN n_top >= 2 THEN 'ensemble' END, CASE WHEN stack THEN 'stacking' END,
  CASE WHEN sup AND n_features > 50 THEN 'hybrid' END, CASE WHEN n_top > 0 THEN 'custom_pipeline' END,
  CASE WHEN missing_pct > 1.0 THEN 'fe_impute' END, CASE WHEN n_categorical > 0 THEN 'fe_encode' END, CASE WHEN sup THEN 'fe_leakage_check' END,
  CASE WHEN automobile_preset IS NOT NULL THEN 'fe_auto_age' END, CASE WHEN automobile_preset IS NOT NULL THEN 'fe_auto_ratios' END,
  CASE WHEN lower(automobile_preset) LIKE '%maintenance%' THEN 'fe_auto_lags' END) AS suggestions FROM j""")
def q_suggestions(spark, sf):
    """R15 suggestion codes per dataset."""
    meta, req = _meta_all(spark, sf), _req(spark)
    top = R.recommend_top(meta, req, R.feedback_bias(_feedback(spark, sf)))
    return R.suggestion_flags(top, meta, req).select("dataset_id", F.array_join("suggestions", ",").alias("suggestions"))


def _with_linearity(spark, sf):
    """Meta-features with a rule-made linearity per dataset, so that the linearity and noise rules (R6, R7, R10) fire."""
    parts = []
    for k, (ds, t, tgt, task, _, _) in enumerate(DATASETS):
        lin = spark.createDataFrame([((0.8, 0.3)[k % 2],)], "linearity_score double")
        parts.append(R.meta_features(table(spark, sf, t), ds, tgt, task, linearity=lin))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("recommend_reasons", "WITH x AS (SELECT * FROM " + _scored_sql().replace(
    "CAST(NULL AS DOUBLE) AS linearity_score", "CASE WHEN 'lineitem_flag customer_segments' LIKE '%' || dataset_id || '%' THEN 0.8 ELSE 0.3 END AS linearity_score").replace(
    "CAST(NULL AS VARCHAR) AS noise_level", "CASE WHEN 'lineitem_flag customer_segments' LIKE '%' || dataset_id || '%' THEN 'Low' ELSE 'High' END AS noise_level") + """)
SELECT dataset_id, key AS algorithm_key, score_total, concat_ws(',',
  CASE WHEN few AND (linear OR low LIKE '%logistic%') THEN 'small_data_linear' END,
  CASE WHEN n_features > 100 AND n_samples > 10000 AND (tree OR boost) THEN 'wide_data_trees' END,
  CASE WHEN n_categorical > 10 AND native THEN 'many_categoricals' END,
  CASE WHEN class_weight_balanced THEN 'class_weights' END,
  CASE WHEN noise_level = 'High' AND (low LIKE '%ridge%' OR svm OR tree) THEN 'noise_robust' END,
  CASE WHEN corr_high_pair_ratio > 0.05 AND (low LIKE '%ridge%' OR low LIKE '%lasso%' OR linear) THEN 'collinear_regularised' END,
  CASE WHEN linearity_score < 0.4 AND (boost OR tree) THEN 'non_linear' END,
  CASE WHEN contains(preset, 'car price') AND (key LIKE '%xgboost%' OR key LIKE '%lightgbm%' OR low LIKE '%random forest%') THEN 'preset_car_price' END,
  CASE WHEN contains(preset, 'fuel') AND (low LIKE '%gradient%' OR linear) THEN 'preset_fuel' END,
  CASE WHEN contains(preset, 'segmentation') AND task_type = 'clustering' AND (key LIKE '%kmeans%' OR key LIKE '%dbscan%') THEN 'preset_segmentation' END) AS reasons
FROM x""")
def q_reasons(spark, sf):
    """Why a card was scored up, as codes, with the linearity and noise rules in force."""
    s = R.score_candidates(_with_linearity(spark, sf), _req(spark), R.feedback_bias(_feedback(spark, sf)))
    return R.with_reasons(s).select("dataset_id", F.col("key").alias("algorithm_key"), "score_total", F.array_join("reasons", ",").alias("reasons"))


@register("meta_signature", """WITH m AS ({META}),
 j AS (SELECT dataset_id, '{' || concat_ws(', ',
   '"class_imbalance": ' || coalesce(regexp_replace(regexp_replace(CAST(CAST(class_imbalance AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null'),
   '"corr_high_pair_ratio": ' || coalesce(regexp_replace(regexp_replace(CAST(CAST(corr_high_pair_ratio AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null'),
   '"corr_mean_abs": ' || coalesce(regexp_replace(regexp_replace(CAST(CAST(corr_mean_abs AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null'),
   '"linearity_score": ' || coalesce(regexp_replace(regexp_replace(CAST(CAST(linearity_score AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null'),
   '"missing_pct": ' || coalesce(regexp_replace(regexp_replace(CAST(CAST(missing_pct AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '[.]$', '.0'), 'null'),
   '"n_categorical": ' || CAST(n_categorical AS VARCHAR), '"n_features": ' || CAST(n_features AS VARCHAR),
   '"n_numeric": ' || CAST(n_numeric AS VARCHAR), '"n_samples": ' || CAST(n_samples AS VARCHAR),
   '"noise_level": ' || coalesce('"' || noise_level || '"', 'null')) || '}' AS canonical FROM m)
SELECT dataset_id, canonical, md5(canonical) AS signature FROM j""".replace("{META}", META_SQL[1:-1]))
def q_signature(spark, sf):
    """SC2: md5 signature of each dataset's meta-features."""
    return R.signature(_meta_all(spark, sf))


@register("meta_linearity")
def q_linearity(spark, sf):
    """R6 + R7: linearity score and noise level for the two supervised datasets."""
    parts = []
    for ds, t, tgt, task, _, _ in DATASETS:
        if task not in ("classification", "regression"):
            continue
        df = table(spark, sf, t)
        lin = R.linearity_score(df, tgt, task)
        parts.append(R.meta_features(df, ds, tgt, task, linearity=lin)
                     .select("dataset_id", "linearity_score", "noise_level"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _sig1_sql():
    from tabsmith.plans.fixtures import LINEITEM_COLUMNS, LINEITEM_NULLS_SQL
    names = "[" + ", ".join('"' + n + '"' for n, _ in LINEITEM_COLUMNS) + "]"
    miss = " + ".join(f"count(*) - count({n})" for n, _ in LINEITEM_COLUMNS)
    num = (f"regexp_replace(regexp_replace(CAST(CAST(({miss}) * 100.0 / (count(*) * {len(LINEITEM_COLUMNS)}) / 100 "
           f"AS DECIMAL(38, 9)) AS VARCHAR), '0+$', ''), '[.]$', '.0')")
    body = (f"'{{\"cols\": {names}, \"missing\": ' || {num} || ', \"shape\": [' || CAST(count(*) AS VARCHAR) || "
            f"', {len(LINEITEM_COLUMNS)}]}}'")
    return f"SELECT {body} AS canonical, md5({body}) AS signature FROM {LINEITEM_NULLS_SQL}"


@register("dataset_signature", _sig1_sql())
def q_dataset_sig(spark, sf):
    """SC1: md5 of the canonical JSON of shape, column names and mean missing share."""
    from tabsmith.plans.fixtures import lineitem_nulls
    from tabsmith.operators.profile import overview
    df = lineitem_nulls(spark, sf)
    names = F.concat(F.lit("["), F.lit(", ".join('"' + x + '"' for x in df.columns)), F.lit("]"))
    ov = overview(df)
    share = (F.col("missing_pct") / 100).cast("decimal(38,9)").cast("string")
    share = F.regexp_replace(F.regexp_replace(share, "0+$", ""), "[.]$", ".0")
    body = F.concat(F.lit('{"cols": '), names, F.lit(', "missing": '), share,
                    F.lit(', "shape": ['), F.col("rows").cast("string"), F.lit(", "), F.col("columns").cast("string"),
                    F.lit("]}"))
    return ov.select(body.alias("canonical"), F.md5(body).alias("signature"))
