"""Preprocessing queries (M*, C*, E*, O*, K*, F*) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import columns as COL
from tabsmith.operators import preprocess as PP
from tabsmith.operators import select as SEL
from tabsmith.plans import steps as ST
from tabsmith.plans.catalog import register, rnd, round_sig_like_sql, sig_sql
from tabsmith.plans.fixtures import (DESIGN_MATRIX_SQL, EVENTS_NONFINITE_SQL, LINEITEM_NULLS_SQL,
                                     design_matrix, events_mixed_text, events_nonfinite, lineitem_nulls,
                                     table)

T = "WITH t AS " + LINEITEM_NULLS_SQL + "\n"
VALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li_vals(spark, sf):
    return lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", *VALS, "l_returnflag")


# ------------------------------------------------------------------ imputation

def _impute_q(strategy, cols, extra=None):
    def q(spark, sf):
        df = _li_vals(spark, sf)
        spec = {"operation": "impute", "params": {"columns": cols, "strategy": strategy, **(extra or {})}}
        out = PP.fit_transform(df, spec)
        return rnd(out.select("l_orderkey", "l_linenumber", *cols), {x: 4 for x in cols if x != "l_returnflag"})
    return q


register("impute_mean", T + """SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM t)), 4) AS l_quantity,
  round(coalesce(l_extendedprice, (SELECT avg(l_extendedprice) FROM t)), 4) AS l_extendedprice FROM t""")(
    _impute_q("mean", ["l_quantity", "l_extendedprice"]))

register("impute_median", T + """SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)), 4) AS l_quantity,
  round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM t)), 4) AS l_extendedprice
  FROM t""")(_impute_q("median", ["l_quantity", "l_extendedprice"]))

register("impute_mode", T + """SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT l_quantity FROM t WHERE l_quantity IS NOT NULL GROUP BY 1
                              ORDER BY count(*) DESC, 1 LIMIT 1)), 4) AS l_quantity,
  coalesce(l_returnflag, (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1
                          ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM t""")(
    _impute_q("most_frequent", ["l_quantity", "l_returnflag"]))

register("impute_constant", T + """SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, -1.0), 4) AS l_quantity, round(coalesce(l_extendedprice, -1.0), 4) AS l_extendedprice
  FROM t""")(_impute_q("constant", ["l_quantity", "l_extendedprice"], {"fill_value": -1}))


ORDER_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _interp_sql():
    order = ", ".join(f"{x} ASC NULLS FIRST" for x in ORDER_ALL)
    sel = []
    for x in ("l_quantity", "l_extendedprice"):
        sel.append(f"""last_value(CASE WHEN {x} IS NOT NULL THEN pos END IGNORE NULLS) OVER wp AS {x}_pp,
  last_value({x} IGNORE NULLS) OVER wp AS {x}_pv,
  first_value(CASE WHEN {x} IS NOT NULL THEN pos END IGNORE NULLS) OVER wn AS {x}_np,
  first_value({x} IGNORE NULLS) OVER wn AS {x}_nv""")

    def fill(x):
        return f"""round(CASE WHEN {x} IS NOT NULL THEN {x}
  WHEN {x}_pp IS NOT NULL AND {x}_np IS NOT NULL THEN {x}_pv + ({x}_nv - {x}_pv) * (pos - {x}_pp) / ({x}_np - {x}_pp)
  WHEN {x}_pp IS NOT NULL THEN {x}_pv ELSE {x}_nv END, 4) AS {x}"""
    return (T + f""", o AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM t),
 p AS (SELECT *, {', '.join(sel)} FROM o
   WINDOW wp AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          wn AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, {fill('l_quantity')}, {fill('l_extendedprice')} FROM p""")


@register("interpolate_linear", _interp_sql())
def q_interpolate(spark, sf):
    df = lineitem_nulls(spark, sf)
    spec = {"operation": "interpolate", "params": {"columns": ["l_quantity", "l_extendedprice"],
                                                   "order_by": ORDER_ALL}}
    out = PP.fit_transform(df, spec)
    return rnd(out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
               {"l_quantity": 4, "l_extendedprice": 4})


# ------------------------------------------------------------------ scaling

def _scale_sql(center, scale):
    sel = []
    stats = []
    for x in VALS:
        stats.append(f"{center.format(x=x)} AS c_{x}, {scale.format(x=x)} AS s_{x}")
        sel.append(f"round((CAST({x} AS DOUBLE) - c_{x}) / CASE WHEN s_{x} IS NULL OR s_{x} = 0 THEN 1 ELSE s_{x} END,"
                   f" 6) AS {x}")
    return T + f", s AS (SELECT {', '.join(stats)} FROM t)\nSELECT l_orderkey, l_linenumber, {', '.join(sel)} FROM t, s"


def _scale_q(method):
    def q(spark, sf):
        df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", *VALS)
        spec = {"operation": "scale", "params": {"columns": VALS, "method": method}}
        return rnd(PP.fit_transform(df, spec), {x: 6 for x in VALS})
    return q


register("scale_standard", _scale_sql("avg({x})", "stddev_pop({x})"))(_scale_q("standard"))
register("scale_minmax", _scale_sql("min({x})", "max({x}) - min({x})"))(_scale_q("minmax"))
register("scale_robust", _scale_sql("quantile_cont({x}, 0.5)",
                                    "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"))(_scale_q("robust"))
register("scale_maxabs", _scale_sql("0.0", "max(abs({x}))"))(_scale_q("maxabs"))

DM_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rf_a", "rf_n", "rf_r", "ls_f"]


@register("scale_exclude_binary", f"""WITH d AS {DESIGN_MATRIX_SQL},
 s AS (SELECT {', '.join(f'avg({x}) AS c_{x}, stddev_pop({x}) AS s_{x}' for x in DM_FEATS[:4])} FROM d)
SELECT {', '.join(f'round(({x} - c_{x}) / CASE WHEN s_{x} = 0 THEN 1 ELSE s_{x} END, 6) AS {x}' for x in DM_FEATS[:4])},
  {', '.join(DM_FEATS[4:])}, y_bin FROM d, s""")
def q_scale_exclude_binary(spark, sf):
    df = design_matrix(spark, sf).select(*DM_FEATS, "y_bin")
    spec = {"operation": "scale", "params": {"method": "standard", "scope": "exclude_binary", "target": "y_bin"}}
    return rnd(PP.fit_transform(df, spec), {x: 6 for x in DM_FEATS[:4]})


# ------------------------------------------------------------------ encoding

def _enc_q(method, cols, extra=None, keep=("o_orderkey",), digits=None):
    def q(spark, sf):
        df = table(spark, sf, "orders").select(*keep, *cols, "o_totalprice")
        spec = {"operation": "encode", "params": {"columns": cols, "method": method, **(extra or {})}}
        out = PP.fit_transform(df, spec).drop("o_totalprice")
        return rnd(out, {x: digits for x in cols} if digits else {})
    return q


register("encode_label", """SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority,
  CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus FROM orders""")(
    _enc_q("label", ["o_orderpriority", "o_orderstatus"]))

register("encode_ordinal", """SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders""")(
    _enc_q("ordinal", ["o_orderpriority"]))

register("encode_frequency", """SELECT o_orderkey,
  CAST(count(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS o_orderpriority,
  CAST(count(*) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS o_orderstatus FROM orders""")(
    _enc_q("frequency", ["o_orderpriority", "o_orderstatus"]))

register("encode_target", """SELECT o_orderkey,
  round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS o_orderpriority FROM orders""")(
    _enc_q("target", ["o_orderpriority"], {"target": "o_totalprice"}, digits=4))

register("encode_onehot", """SELECT o_orderkey,
  o_orderstatus = 'F' AS o_orderstatus_F, o_orderstatus = 'O' AS o_orderstatus_O,
  o_orderstatus = 'P' AS o_orderstatus_P FROM orders""")(_enc_q("onehot", ["o_orderstatus"]))

register("encode_capped_label", """WITH top AS (SELECT o_orderpriority AS v FROM orders GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 3),
 x AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN (SELECT v FROM top) THEN o_orderpriority
                              ELSE '__OTHER__' END AS v FROM orders)
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS o_orderpriority FROM x""")(
    _enc_q("label", ["o_orderpriority"], {"max_categories": 3}))


# ------------------------------------------------------------------ outliers

def _clip_sql(lo, hi, cond):
    stats = ", ".join(f"{lo.format(x=x)} AS lo_{x}, {hi.format(x=x)} AS hi_{x}, {cond.format(x=x)} AS ok_{x}"
                      for x in VALS)
    sel = ", ".join(f"round(CASE WHEN ok_{x} AND {x} IS NOT NULL THEN least(greatest({x}, lo_{x}), hi_{x}) ELSE {x} END, 4) AS {x}"
                    for x in VALS)
    return T + f", s AS (SELECT {stats} FROM t)\nSELECT {sel} FROM t, s"


def _out_q(method, extra=None):
    def q(spark, sf):
        df = lineitem_nulls(spark, sf).select(*VALS)
        spec = {"operation": "outliers", "params": {"method": method, **(extra or {})}}
        return rnd(PP.fit_transform(df, spec), {x: 4 for x in VALS})
    return q


register("outlier_zscore", _clip_sql("avg({x}) - 3 * stddev_pop({x})", "avg({x}) + 3 * stddev_pop({x})",
                                     "stddev_pop({x}) > 0"))(_out_q("zscore", {"threshold": 3.0}))
register("outlier_iqr", _clip_sql(
    "quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))",
    "quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))",
    "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) > 0"))(_out_q("iqr", {"multiplier": 1.5}))
register("outlier_winsorize", _clip_sql("quantile_cont({x}, 0.05)", "quantile_cont({x}, 0.95)",
                                        "TRUE"))(_out_q("winsorize", {"tail": 0.05}))


# ------------------------------------------------------------------ feature selection

def _feat_union(expr, src="d"):
    return "\nUNION ALL\n".join(f"SELECT {i} AS position, '{x}' AS feature, {expr.format(x=x)} AS score FROM {src}"
                                for i, x in enumerate(DM_FEATS))


def _x(x):
    return f"coalesce(CAST({x} AS DOUBLE), 0.0)"


def _topk_sql(scores_cte, k, digits):
    return (f"""WITH d AS {DESIGN_MATRIX_SQL}, {scores_cte}
SELECT position, feature, round(score, {digits}) AS score,
  row_number() OVER (ORDER BY score DESC NULLS LAST, position DESC) <= {k} AS selected FROM sc""")


def _sel_q(params, digits=4, sig=None):
    def q(spark, sf):
        t = params.get("target")
        df = design_matrix(spark, sf).select(*DM_FEATS, *([t] if t else []))
        sc = SEL.selection_scores(df, params)
        out = sc.select(F.col("position").cast("int").alias("position"), "feature", "score", "selected")
        if sig:
            return out.withColumn("score", round_sig_like_sql(F.col("score"), sig))
        return rnd(out, {"score": digits})
    return q


_CM = "cm AS (SELECT y_bin, count(*)::DOUBLE AS n, " + ", ".join(
    f"sum({_x(x)}) AS s{i}, sum({_x(x)} * {_x(x)}) AS q{i}" for i, x in enumerate(DM_FEATS)) + " FROM d GROUP BY y_bin)"
_ANOVA = _CM + ", g AS (SELECT sum(n) AS N, count(*)::DOUBLE AS K, " + ", ".join(
    f"sum(s{i}) AS S{i}, sum(q{i}) AS Q{i}, sum(s{i} * s{i} / n) AS B{i}" for i in range(len(DM_FEATS))) + \
    " FROM cm), sc AS (" + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{x}' AS feature, ((B{i} - S{i} * S{i} / N) / (K - 1)) / ((Q{i} - B{i}) / (N - K)) "
        f"AS score FROM g" for i, x in enumerate(DM_FEATS)) + ")"

register("select_anova_f", _topk_sql(_ANOVA, 4, 4))(
    _sel_q({"method": "select_k_best", "score_func": "f_classif", "k": 4, "target": "y_bin"}))

_CHI = _CM + ", g AS (SELECT sum(n) AS NN, " + ", ".join(f"sum(s{i}) AS T{i}" for i in range(len(DM_FEATS))) + \
    " FROM cm), sc AS (" + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{x}' AS feature, sum((s{i} - n / NN * T{i}) * (s{i} - n / NN * T{i}) / (n / NN * T{i}))"
        f" AS score FROM cm, g" for i, x in enumerate(DM_FEATS)) + ")"
register("select_chi2", _topk_sql(_CHI, 3, 4))(
    _sel_q({"method": "select_k_best", "score_func": "chi2", "k": 3, "target": "y_bin"}))

_FREG = "sc AS (" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{x}' AS feature, corr({_x(x)}, y_reg) * corr({_x(x)}, y_reg) / "
    f"(1 - corr({_x(x)}, y_reg) * corr({_x(x)}, y_reg)) * (count(*) - 2) AS score FROM d WHERE y_reg IS NOT NULL"
    for i, x in enumerate(DM_FEATS)) + ")"
register("select_f_regression", _topk_sql(_FREG, 5, 4))(
    _sel_q({"method": "select_k_best", "score_func": "f_regression", "k": 5, "target": "y_reg"}))


def _mi_sql():
    bins = []
    for i, x in enumerate(DM_FEATS):
        bins.append(f"CASE WHEN (SELECT max({_x(x)}) - min({_x(x)}) FROM d) = 0 THEN 0 ELSE "
                    f"CAST(least(floor(({_x(x)} - (SELECT min({_x(x)}) FROM d)) / "
                    f"((SELECT max({_x(x)}) - min({_x(x)}) FROM d) / 10)), 9) AS INTEGER) END AS b{i}")
    parts = []
    for i, x in enumerate(DM_FEATS):
        parts.append(f"""SELECT {i} AS position, '{x}' AS feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS score
FROM (SELECT nxy, sum(nxy) OVER (PARTITION BY b) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny, sum(nxy) OVER () AS n
      FROM (SELECT b{i} AS b, CAST(y_bin AS VARCHAR) AS y, count(*)::DOUBLE AS nxy FROM bd GROUP BY 1, 2))""")
    return f"bd AS (SELECT y_bin, {', '.join(bins)} FROM d), sc AS ({' UNION ALL '.join(parts)})"


register("select_mutual_info", _topk_sql(_mi_sql(), 3, 6))(
    _sel_q({"method": "select_k_best", "score_func": "mutual_info_classif", "k": 3, "target": "y_bin"}, 6))

register("select_variance", f"""WITH d AS {DESIGN_MATRIX_SQL}
SELECT position, feature, {sig_sql('score', 8)} AS score, score > 0.01 AS selected
FROM ({_feat_union(f'var_pop({{x}})')})""")(_sel_q({"method": "variance", "threshold": 0.01}, sig=8))


def _corr_sel_sql():
    pairs = []
    for i, a in enumerate(DM_FEATS):
        for b in DM_FEATS[i + 1:]:
            pairs.append(f"SELECT '{b}' AS feature FROM d HAVING abs(corr({a}, {b})) > 0.5")
    feats = " UNION ALL ".join(f"SELECT {i} AS position, '{x}' AS feature" for i, x in enumerate(DM_FEATS))
    return (f"WITH d AS {DESIGN_MATRIX_SQL}, hit AS ({' UNION '.join(pairs)})\n"
            f"SELECT position, feature, CAST(NULL AS DOUBLE) AS score, feature NOT IN (SELECT feature FROM hit) "
            f"AS selected FROM ({feats})")


register("select_correlation", _corr_sel_sql())(_sel_q({"method": "correlation", "threshold": 0.5}))


# ------------------------------------------------------------------ projections / filters

@register("drop_missing", T + "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM t "
                              "WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def q_drop_missing(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return PP.fit_transform(df, {"operation": "drop_missing",
                                 "params": {"columns": ["l_quantity", "l_returnflag"]}})


@register("drop_rename_columns", "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders")
def q_drop_rename(spark, sf):
    spec = [{"operation": "drop_columns", "params": {"columns": ["o_custkey", "o_totalprice", "o_orderdate",
                                                                 "o_orderpriority", "not_a_column"]}},
            {"operation": "rename_columns", "params": {"mapping": {"o_orderkey": "order_id",
                                                                   "o_orderstatus": "status", "nope": "x"}}}]
    _, out = ST.apply(table(spark, sf, "orders"), spec)
    return out


@register("coerce_orders", """SELECT o_orderkey, epoch(o_orderdate) AS o_orderdate,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders""")
def q_coerce_orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return COL.coerce_features(df)


@register("coerce_mixed_text", """SELECT event_id,
  TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS mixed
  FROM events""")
def q_coerce_mixed(spark, sf):
    return COL.coerce_features(events_mixed_text(spark, sf).select("event_id", "mixed"))


@register("finite_filter", f"""SELECT event_id, value FROM {EVENTS_NONFINITE_SQL}
  WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)""")
def q_finite(spark, sf):
    df = events_nonfinite(spark, sf).select("event_id", "value")
    return COL.drop_nonfinite(df, ["value"])


@register("sample_rows", """SELECT * FROM lineitem ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey)),
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 500""")
def q_sample(spark, sf):
    """deterministic hash sample of 500 lineitem rows."""
    return COL.sample_n(table(spark, sf, "lineitem"), 500, ["l_orderkey", "l_linenumber", "l_partkey"])


@register("outlier_isolation_forest")
def q_isoforest(spark, sf):
    """Isolation forest (100 trees, 256-row hash samples) drops the 5 % most anomalous rows."""
    df = lineitem_nulls(spark, sf).select(*VALS)
    return PP.fit_transform(df, {"operation": "outliers", "params": {"method": "isolation_forest",
                                                                     "contamination": 0.05}})


PREVIEW_SQL = T + """, i AS (SELECT l_orderkey, l_linenumber,
    coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity,
    coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM t)) AS l_extendedprice,
    l_discount, l_tax,
    coalesce(l_returnflag, (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1
                            ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM t),
 e AS (SELECT * EXCLUDE (l_returnflag), CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS l_returnflag FROM i)
SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice,
  l_discount, l_tax, l_returnflag, (SELECT count(*) FROM t) AS shape_rows, 7 AS shape_cols FROM e
ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag LIMIT 12"""


@register("preprocess_preview", PREVIEW_SQL)
def q_preview(spark, sf):
    """PR25: apply steps 0..1 of a three-step spec; first 12 rows (ordered) plus the shape."""
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", *VALS, "l_returnflag")
    spec = [{"name": "imp", "operation": "impute", "params": {"strategy": "median"}},
            {"name": "enc", "operation": "encode", "params": {"columns": ["l_returnflag"], "method": "frequency"}},
            {"name": "sc", "operation": "scale", "params": {"method": "standard"}}]
    head, (rows, cols) = ST.preview(df, spec, 1, 12,
                                    order_by=["l_orderkey", "l_linenumber", *VALS, "l_returnflag"])
    out = head.withColumn("shape_rows", F.lit(rows)).withColumn("shape_cols", F.lit(cols))
    return rnd(out, {"l_quantity": 4, "l_extendedprice": 4})
