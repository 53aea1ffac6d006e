"""Explanation queries (X*) with rule-model scorers, so most have DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.columns import md5_uniform_sql
from tabsmith.operators import explain as X
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import REG_PRED_SQL, reg_pred, table

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
# rule "models" (a linear part plus an interaction, so ALE / PDP-2D are not trivial)
REG_RULE = "l_quantity * 1000 + l_extendedprice * 0.09 - 20000 * l_discount * l_tax"
CLF_P1 = "least(1.0, l_discount * 10 + l_tax * 2)"
CLF_RULE = f"CAST({CLF_P1} >= 0.5 AS DOUBLE)"


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, *FEATS, "l_returnflag")


def _reg_scorer():
    return X.Scorer.sql(REG_RULE, FEATS)


COEF = {"l_quantity": 1000.0, "l_extendedprice": 0.09, "l_tax": -300.0}


@register("explain_linear_shap", "\nUNION ALL\n".join(
    f"SELECT l_orderkey, l_linenumber, '{f}' AS feature, round({w} * ({f} - (SELECT avg({f}) FROM lineitem)), 4) AS shap "
    f"FROM lineitem" for f, w in COEF.items()))
def q_shap(spark, sf):
    """Exact linear Shapley values; sum = prediction - mean prediction."""
    return rnd(X.linear_shap(_li(spark, sf), COEF, KEYS), {"shap": 4})


def _drivers_sql(k: int) -> str:
    """Top drivers ranked per line (``rid``): several lines share (l_orderkey, l_linenumber)."""
    parts = " UNION ALL ".join(
        f"SELECT rid, l_orderkey, l_linenumber, '{f}' AS feature, {w} * ({f} - (SELECT avg({f}) FROM lineitem)) AS shap FROM l"
        for f, w in COEF.items())
    return f"""WITH l AS (SELECT row_number() OVER () AS rid, * FROM lineitem), s AS ({parts}),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(shap) DESC, feature) AS r1 FROM s),
 r2 AS (SELECT *, row_number() OVER (PARTITION BY rid, sign(shap) ORDER BY abs(shap) DESC, feature) AS r2
        FROM r WHERE r1 <= {k})
SELECT l_orderkey, l_linenumber, feature, round(shap, 4) AS shap, CASE WHEN shap > 0 THEN 'up' ELSE 'down' END AS direction
FROM r2 WHERE r2 <= {k // 2} AND shap <> 0"""


@register("explain_top_drivers", _drivers_sql(8))
def q_drivers(spark, sf):
    """Per row the 8 largest contributions, at most 4 up and 4 down."""
    return rnd(X.top_drivers(_li(spark, sf), COEF, KEYS), {"shap": 4})


@register("explain_top_drivers_k2", _drivers_sql(2))
def q_drivers_2(spark, sf):
    """Per row the 2 largest contributions, at most 1 up and 1 down."""
    return rnd(X.top_drivers(_li(spark, sf), COEF, KEYS, k=2), {"shap": 4})


def _grid_sql(col, n):
    return (f"(SELECT (SELECT min({col}) FROM lineitem) + ((SELECT max({col}) FROM lineitem) - (SELECT min({col}) FROM lineitem))"
            f" * i / {n - 1} AS g FROM (SELECT unnest(range({n})) AS i))")


@register("explain_pdp_1d", f"""SELECT round(g.g, 4) AS grid,
  round(avg(g.g * 1000 + l_extendedprice * 0.09 - 20000 * l_discount * l_tax), 4) AS pd
FROM lineitem, {_grid_sql('l_quantity', 20)} g GROUP BY g.g""")
def q_pdp(spark, sf):
    """Partial dependence of the rule model on l_quantity (20-point grid)."""
    return rnd(X.partial_dependence(_li(spark, sf), _reg_scorer(), "l_quantity", n=20), {"grid": 4, "pd": 4})


@register("explain_pdp_2d", f"""SELECT round(a.g, 6) AS grid1, round(b.g, 6) AS grid2,
  round(avg(l_quantity * 1000 + l_extendedprice * 0.09 - 20000 * a.g * b.g), 4) AS pd
FROM lineitem, {_grid_sql('l_discount', 10)} a, {_grid_sql('l_tax', 10)} b GROUP BY a.g, b.g""")
def q_pdp2(spark, sf):
    """10 x 10 partial dependence over discount x tax."""
    return rnd(X.partial_dependence_2d(_li(spark, sf), _reg_scorer(), "l_discount", "l_tax", n=10),
               {"grid1": 6, "grid2": 6, "pd": 4})


@register("explain_ale", """WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e
                                  FROM lineitem),
 b AS (SELECT greatest(1, least(10, (""" + " + ".join(f"CASE WHEN e[{i}] < l_quantity THEN 1 ELSE 0 END" for i in range(1, 12)) + """))) AS bin,
              e, l_extendedprice, l_discount, l_tax FROM lineitem, q),
 d AS (SELECT bin, e[bin + 1] AS upper_edge, count(*) AS n,
              avg((e[bin + 1] * 1000 + l_extendedprice * 0.09 - 20000 * l_discount * l_tax)
                - (e[bin] * 1000 + l_extendedprice * 0.09 - 20000 * l_discount * l_tax)) AS effect FROM b GROUP BY bin, e),
 c AS (SELECT *, sum(effect) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ale FROM d)
SELECT bin, round(upper_edge, 4) AS upper_edge, n, round(ale - (SELECT sum(ale * n) / sum(n) FROM c), 4) AS ale FROM c""")
def q_ale(spark, sf):
    """Accumulated local effects of l_quantity (10 quantile bins)."""
    out = X.ale(_li(spark, sf), _reg_scorer(), "l_quantity", bins=10)
    return rnd(out.withColumn("bin", F.col("bin").cast("int")), {"upper_edge": 4, "ale": 4})


@register("explain_what_if", """WITH s AS (SELECT stddev_samp(l_quantity) AS sq, stddev_samp(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, f.feature,
  round(CASE WHEN f.feature = 'l_quantity' THEN (l_quantity - sq) * 1000 + l_extendedprice * 0.09
             ELSE l_quantity * 1000 + (l_extendedprice - sp) * 0.09 END - 20000 * l_discount * l_tax, 4) AS minus,
  round(CASE WHEN f.feature = 'l_quantity' THEN (l_quantity + sq) * 1000 + l_extendedprice * 0.09
             ELSE l_quantity * 1000 + (l_extendedprice + sp) * 0.09 END - 20000 * l_discount * l_tax, 4) AS plus,
  round(l_quantity * 1000 + l_extendedprice * 0.09 - 20000 * l_discount * l_tax, 4) AS base
FROM lineitem, s, (SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature) f""")
def q_what_if(spark, sf):
    """Prediction at x -/+ 1 std for two features, per row."""
    out = X.what_if(_li(spark, sf), _reg_scorer(), KEYS, ["l_quantity", "l_extendedprice"])
    return rnd(out, {"minus": 4, "plus": 4, "base": 4})


WIDE = 30


def _wide_rule() -> str:
    return " + ".join(f"{i + 1} * f{i}" for i in range(WIDE))


@register("explain_what_if_wide", f"""WITH w AS (SELECT l_orderkey, l_linenumber, {', '.join(f'l_quantity + {i} * l_tax AS f{i}' for i in range(WIDE))} FROM lineitem),
 s AS (SELECT {', '.join(f'stddev_samp(f{i}) AS s{i}' for i in range(WIDE))} FROM w),
 b AS (SELECT l_orderkey, l_linenumber, {_wide_rule()} AS base, s.* FROM w, s)
""" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, 'f{i}' AS feature, round(base - {i + 1} * s{i}, 4) AS minus, round(base + {i + 1} * s{i}, 4) AS plus FROM b"
                         for i in range(WIDE)))
def q_what_if_wide(spark, sf):
    """X10 over 30 features: none is left out."""
    li = table(spark, sf, "lineitem")
    wide = li.select(*KEYS, *[(F.col("l_quantity") + i * F.col("l_tax")).alias(f"f{i}") for i in range(WIDE)])
    out = X.what_if(wide, X.Scorer.sql(_wide_rule(), [f"f{i}" for i in range(WIDE)]), KEYS)
    return rnd(out.select(*KEYS, "feature", "minus", "plus"), {"minus": 4, "plus": 4})


@register("explain_error_analysis", f"""SELECT 'rule' AS model, count(*) FILTER (WHERE label <> prediction) AS misclassified,
  round(avg(CASE WHEN label <> prediction THEN greatest(p1, 1 - p1) END), 6) AS mean_conf_wrong, count(*) AS n
FROM (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS label, {CLF_RULE} AS prediction, {CLF_P1} AS p1 FROM lineitem)""")
def q_errors(spark, sf):
    """X11: misclassified count and mean confidence on wrong rows (rule classifier)."""
    li = _li(spark, sf).withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    pred = X.Scorer.sql(CLF_RULE, FEATS, CLF_P1)(li).withColumn("model", F.lit("rule"))
    return rnd(X.error_analysis(pred), {"mean_conf_wrong": 6})


@register("explain_hard_examples", f"""SELECT l_orderkey, l_linenumber, round(label, 4) AS label, round(prediction, 4) AS prediction,
  round(label - prediction, 4) AS residual FROM {REG_PRED_SQL} WHERE model = 'm1'
ORDER BY abs(label - prediction) DESC, l_orderkey, l_linenumber, label LIMIT 10""")
def q_hard(spark, sf):
    """Top 10 |residual| of rule model m1."""
    rp = reg_pred(spark, sf).where(F.col("model") == "m1")
    out = X.hard_examples(rp.select(*KEYS, "label", "prediction"), [*KEYS, "label"])
    return rnd(out.select(*KEYS, "label", "prediction", "residual"), {"label": 4, "prediction": 4, "residual": 4})


@register("explain_group_premium", """SELECT l_returnflag AS grp, round(avg(l_extendedprice), 4) AS group_mean, count(*) AS n,
  round(avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM lineitem), 4) AS premium FROM lineitem GROUP BY 1""")
def q_premium(spark, sf):
    """Group mean of the price by return flag vs the overall mean."""
    return rnd(X.group_premium(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"),
               {"group_mean": 4, "premium": 4})


@register("explain_decision_surface", f"""WITH a AS (SELECT i, g FROM (SELECT unnest(range(20)) AS i) x,
    LATERAL (SELECT (SELECT min(l_discount) FROM lineitem) + ((SELECT max(l_discount) FROM lineitem)
             - (SELECT min(l_discount) FROM lineitem)) * x.i / 19 AS g)),
 b AS (SELECT i AS j, g FROM (SELECT unnest(range(20)) AS i) x,
    LATERAL (SELECT (SELECT min(l_tax) FROM lineitem) + ((SELECT max(l_tax) FROM lineitem)
             - (SELECT min(l_tax) FROM lineitem)) * x.i / 19 AS g))
SELECT a.i, b.j, round(a.g, 6) AS l_discount, round(b.g, 6) AS l_tax, round(least(1.0, a.g * 10 + b.g * 2), 6) AS value
FROM a, b""")
def q_surface(spark, sf):
    """20 x 20 grid of P(class 1) over discount x tax (other features at their medians)."""
    out = X.decision_surface(_li(spark, sf), X.Scorer.sql(CLF_RULE, FEATS, CLF_P1), "l_discount", "l_tax", n=20)
    return rnd(out, {"l_discount": 6, "l_tax": 6, "value": 6})


@register("explain_permutation_importance")
def q_perm(spark, sf):
    """Permutation importance (5 repeats) of the rule model on orders-size data (R^2 drop)."""
    li = _li(spark, sf).withColumn("y", F.expr(REG_RULE))
    return X.permutation_importance(li, _reg_scorer(), "y", KEYS, metric="r2", repeats=5)


_DRAW = {k: md5_uniform_sql(["p_partkey", "cand", f"'{k}'"]) for k in ("val0", "val1")}


@register("explain_counterfactuals", f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part),
 r AS (SELECT min(p_size) AS lo0, max(p_size) AS hi0, min(p_retailprice) AS lo1, max(p_retailprice) AS hi1 FROM p),
 -- with two features and up to two changes every candidate changes both
 d AS (SELECT p.*, cand, lo0 + {_DRAW['val0']} * (hi0 - lo0) AS n0, lo1 + {_DRAW['val1']} * (hi1 - lo1) AS n1,
              p_retailprice + 10 * p_size > 1200 AS was, hi0 - lo0 AS w0, hi1 - lo1 AS w1
       FROM p, r, (SELECT unnest(range(1, 301)) AS cand)),
 hit AS (SELECT *, sqrt(((n0 - p_size) / w0) ^ 2 + ((n1 - p_retailprice) / w1) ^ 2) AS distance FROM d WHERE (n1 + 10 * n0 > 1200) <> was)
SELECT p_partkey, round(arg_min(n0, distance), 4) AS new_size, round(arg_min(n1, distance), 4) AS new_price,
  round(min(distance), 6) AS distance, CAST(any_value(was) AS DOUBLE) AS prediction FROM hit GROUP BY p_partkey""")
def q_cf(spark, sf):
    """300 candidates per part; nearest change that flips the rule classifier."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    sc = X.Scorer.sql("CAST(p_retailprice + 10 * p_size > 1200 AS DOUBLE)", ["p_size", "p_retailprice"])
    out = X.counterfactuals(p, sc, ["p_partkey"], n_candidates=300, max_changes=2)
    out = out.select("p_partkey", F.col("cf.p_size").alias("new_size"), F.col("cf.p_retailprice").alias("new_price"), "distance", "prediction")
    return rnd(out, {"new_size": 4, "new_price": 4, "distance": 6})


@register("explain_decision_surface_full", f"""WITH a AS (SELECT i, g FROM (SELECT unnest(range(120)) AS i) x,
    LATERAL (SELECT (SELECT min(l_discount) FROM lineitem) + ((SELECT max(l_discount) FROM lineitem)
             - (SELECT min(l_discount) FROM lineitem)) * x.i / 119 AS g)),
 b AS (SELECT i AS j, g FROM (SELECT unnest(range(120)) AS i) x,
    LATERAL (SELECT (SELECT min(l_tax) FROM lineitem) + ((SELECT max(l_tax) FROM lineitem)
             - (SELECT min(l_tax) FROM lineitem)) * x.i / 119 AS g))
SELECT a.i, b.j, round(a.g, 6) AS l_discount, round(b.g, 6) AS l_tax, round(least(1.0, a.g * 10 + b.g * 2), 6) AS value
FROM a, b""")
def q_surface_full(spark, sf):
    """X16 at the reference's 120 x 120."""
    out = X.decision_surface(_li(spark, sf), X.Scorer.sql(CLF_RULE, FEATS, CLF_P1), "l_discount", "l_tax", n=120)
    return rnd(out, {"l_discount": 6, "l_tax": 6, "value": 6})


@register("error_projection", f"""WITH RECURSIVE d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax, CAST(l_returnflag = 'R' AS INT) AS label,
    CAST(l_discount * 10 >= 0.5 AS INT) AS prediction FROM lineitem),
 s AS (SELECT avg(l_discount) AS m0, avg(l_tax) AS m1, 0.5 * atan2(2 * covar_pop(l_discount, l_tax), var_pop(l_discount) - var_pop(l_tax)) AS t FROM d)
SELECT label <> prediction AS wrong, count(*) AS n, round(avg(c1), 5) AS c1, round(avg(c2), 5) AS c2, round(var_pop(c1), 7) AS v1, round(var_pop(c2), 7) AS v2
FROM (SELECT label, prediction, cos(t) * (l_discount - m0) + sin(t) * (l_tax - m1) AS c1,
             CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN 1 ELSE sign(-sin(t)) END * (-sin(t) * (l_discount - m0) + cos(t) * (l_tax - m1)) AS c2 FROM d, s)
GROUP BY 1""")
def q_error_projection(spark, sf):
    """The scored rows projected on the first two principal components, right and wrong predictions apart."""
    from tabsmith.plans.fixtures import binary_pred
    out = X.error_projection(binary_pred(spark, sf), ["l_discount", "l_tax"], F.col("label") != F.col("prediction"), 2)
    out = out.groupBy(F.col("error").alias("wrong")).agg(F.count(F.lit(1)).alias("n"), F.avg("c1").alias("c1"), F.avg("c2").alias("c2"),
                                                         F.var_pop("c1").alias("v1"), F.var_pop("c2").alias("v2"))
    return rnd(out, {"c1": 5, "c2": 5, "v1": 7, "v2": 7})


@register("explain_sampling_shap")
def q_sampling_shap(spark, sf):
    """Permutation-sampling Shapley values of the rule model (10 permutations, 200 hash-chosen
    background rows broadcast)."""
    from tabsmith.functions.columns import sample_n
    o = table(spark, sf, "orders")
    # four features that vary: price, customer, weekday and day of the order
    li = o.select("o_orderkey", F.col("o_totalprice").alias("l_quantity"), F.col("o_custkey").cast("double").alias("l_extendedprice"),
                  (F.dayofweek("o_orderdate") / 100.0).alias("l_discount"), (F.dayofmonth("o_orderdate") / 100.0).alias("l_tax"))
    bg = sample_n(li, 200, ["o_orderkey"])
    return X.sampling_shap(li, _reg_scorer(), ["o_orderkey"], bg, n_perm=10)


@register("explain_local_surrogate", """WITH s AS (SELECT stddev_pop(p_size) * 10 AS size, stddev_pop(p_retailprice) AS price FROM part)
SELECT '{"p_partkey":' || p_partkey || '}' AS key, feature, round(CASE feature WHEN 'p_size' THEN size ELSE price END, 4) AS weight
FROM part, s, (SELECT unnest(['p_size', 'p_retailprice']) AS feature)""")
def q_lime(spark, sf):
    """Per-part weighted linear surrogate (200 perturbations each) of the rule classifier's score; of a linear score
    the surrogate is its coefficients times the features' deviations, whatever the draws."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    sc = X.Scorer.sql("p_retailprice + 10 * p_size", ["p_size", "p_retailprice"])
    return rnd(X.local_surrogate(p, sc, ["p_partkey"], n_samples=200, top=2), {"weight": 4})


def _dm_prep(spark, sf, target, task):
    from tabsmith.plans import train as TR
    from tabsmith.plans.fixtures import design_matrix
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf_a", "rf_n", "rf_r", "ls_f"]
    return TR.prepare(design_matrix(spark, sf).select(*KEYS, *feats, target), target, KEYS, task)


@register("explain_learning_curve")
def q_learning(spark, sf):
    """5 train sizes x 3 hash folds, decision tree regressor."""
    return X.learning_curve(_dm_prep(spark, sf, "y_reg", "regression"), "reg_decision_tree", params={"max_depth": 6})


@register("explain_validation_curve")
def q_validation(spark, sf):
    """CV score at max_depth in {3, 6, 12}."""
    return X.validation_curve(_dm_prep(spark, sf, "y_bin", "classification"), "clf_decision_tree", "max_depth", 6)


@register("prediction_candidates")
def q_candidates(spark, sf):
    """confident logistic-regression predictions (max class probability >= 0.9), first 50 by key."""
    from tabsmith.plans import train as TR
    prep = _dm_prep(spark, sf, "y_bin", "classification")
    res = TR.train(prep, "clf_logistic")
    return X.prediction_candidates(res.predictions, KEYS, 0.9, 50).drop("probability")
