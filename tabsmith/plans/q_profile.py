"""Profiling queries (PR*) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import profile as P
from tabsmith.plans.catalog import register, rnd, round_sig_like_sql, sig_sql
from tabsmith.plans.fixtures import (DESIGN_MATRIX_SQL, LINEITEM_COLUMNS, LINEITEM_DUPS_SQL, LINEITEM_NULLS_SQL,
                                     lineitem_dups, lineitem_nulls, table)

NUMERIC_DT = {"bigint", "int", "double"}


def _col_sql(pos, name, dtype, src="t"):
    x = f"CAST({name} AS DOUBLE)"
    num = dtype in NUMERIC_DT
    nd = "CAST(NULL AS DOUBLE)"
    stat = (lambda e, d: f"round({e}, {d})") if num else (lambda e, d: nd)
    return f"""SELECT {pos} AS position, '{name}' AS "column", '{dtype}' AS dtype,
  CAST(count(DISTINCT {name}) AS BIGINT) AS "unique",
  round((count(*) - count({name})) * 100.0 / count(*), 6) AS missing_pct,
  {stat(f'avg({x})', 4)} AS mean, {stat(f'quantile_cont({x}, 0.5)', 4)} AS median,
  {stat(f'min({x})', 4)} AS min, {stat(f'max({x})', 4)} AS max,
  {stat(f'stddev_samp({x})', 4)} AS std, {sig_sql(f'var_samp({x})', 8) if num else nd} AS variance,
  {stat(f'skewness({x})', 6)} AS skew, {stat(f'kurtosis({x})', 6)} AS kurtosis,
  {stat(f'quantile_cont({x}, 0.25)', 4)} AS q1, {stat(f'quantile_cont({x}, 0.75)', 4)} AS q3,
  round(count(DISTINCT {name}) / count(*), 6) AS cardinality_ratio
FROM {src}"""


PROFILE_SQL = "WITH t AS " + LINEITEM_NULLS_SQL + "\n" + "\nUNION ALL\n".join(
    _col_sql(i, n, d) for i, (n, d) in enumerate(LINEITEM_COLUMNS))

PROFILE_ROUND = {"missing_pct": 6, "mean": 4, "median": 4, "min": 4, "max": 4, "std": 4,
                 "skew": 6, "kurtosis": 6, "q1": 4, "q3": 4, "cardinality_ratio": 6}


@register("profile_columns", PROFILE_SQL)
def q_profile_columns(spark, sf_dir):
    st = P.column_stats(lineitem_nulls(spark, sf_dir))
    st = st.withColumn("variance", round_sig_like_sql(F.col("variance"), 8))
    return rnd(st.select("position", "column", "dtype", "unique", *PROFILE_ROUND.keys(), "variance"), PROFILE_ROUND)


_MISSING_CELLS = " + ".join(f"count(*) - count({n})" for n, _ in LINEITEM_COLUMNS)
_ALL = ", ".join(n for n, _ in LINEITEM_COLUMNS)


@register("profile_overview", f"""
WITH t AS {LINEITEM_NULLS_SQL},
 d AS (SELECT sum(n - 1) AS dups FROM (SELECT count(*) AS n FROM t GROUP BY ALL_COLS)),
 b AS (SELECT count(*) AS rows, {_MISSING_CELLS} AS missing_count FROM t)
SELECT CAST(rows AS BIGINT) AS rows, CAST({len(LINEITEM_COLUMNS)} AS BIGINT) AS columns,
  CAST(missing_count AS BIGINT) AS missing_count,
  round(missing_count * 100.0 / (rows * {len(LINEITEM_COLUMNS)}), 6) AS missing_pct,
  CAST(dups AS BIGINT) AS duplicates,
  round(greatest(0, least(100, 100 - least(60, missing_count * 100.0 / (rows * {len(LINEITEM_COLUMNS)}) * 1.5)
        - least(25, dups * 100.0 / rows))), 6) AS quality_score
FROM b, d""".replace("ALL_COLS", _ALL))
def q_profile_overview(spark, sf_dir):
    ov = P.overview(lineitem_nulls(spark, sf_dir))
    return rnd(ov.drop("quality_band"), {"missing_pct": 6, "quality_score": 6})


@register("profile_duplicates", f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM {LINEITEM_DUPS_SQL} GROUP BY {_ALL})""")
def q_profile_duplicates(spark, sf_dir):
    return P.duplicate_count(lineitem_dups(spark, sf_dir))


def _stats_cte():
    return "WITH t AS " + LINEITEM_NULLS_SQL + ", s AS (" + "\nUNION ALL\n".join(
        f"""SELECT {i} AS position, '{n}' AS "column", {str(d in NUMERIC_DT).upper()} AS is_numeric,
  {str(d == 'string').upper()} AS is_string, count({n}) AS non_null, count(*) AS rows,
  (count(*) - count({n})) * 100.0 / count(*) AS missing_pct,
  {'skewness(CAST(' + n + ' AS DOUBLE))' if d in NUMERIC_DT else 'NULL'} AS skew,
  {'quantile_cont(CAST(' + n + ' AS DOUBLE), 0.25)' if d in NUMERIC_DT else 'NULL'} AS q1,
  {'quantile_cont(CAST(' + n + ' AS DOUBLE), 0.75)' if d in NUMERIC_DT else 'NULL'} AS q3
FROM t""" for i, (n, d) in enumerate(LINEITEM_COLUMNS)) + ")"


_OUTLIER_UNION = "\nUNION ALL\n".join(
    f"""SELECT {i} AS position, '{n}' AS "column",
  (SELECT count(*) FROM t, s WHERE s.position = {i} AND
     (CAST(t.{n} AS DOUBLE) < s.q1 - 1.5 * (s.q3 - s.q1) OR CAST(t.{n} AS DOUBLE) > s.q3 + 1.5 * (s.q3 - s.q1))) AS o"""
    for i, (n, d) in enumerate(LINEITEM_COLUMNS) if d in NUMERIC_DT)

WARNINGS_SQL = _stats_cte() + f""",
 o AS ({_OUTLIER_UNION})
SELECT 'high_missing' AS warning, "column", round(missing_pct, 6) AS value FROM s WHERE missing_pct > 20
UNION ALL
SELECT * FROM (SELECT 'skewed' AS warning, "column", round(skew, 6) AS value FROM s
  WHERE is_numeric AND non_null >= 30 AND abs(skew) > 1 ORDER BY position LIMIT 1)
UNION ALL
SELECT 'categorical', NULL, CAST(count(*) AS DOUBLE) FROM s WHERE is_string HAVING count(*) > 0
UNION ALL
SELECT * FROM (SELECT 'outliers' AS warning, o."column", CAST(o.o AS DOUBLE) AS value FROM o JOIN s USING (position)
  WHERE s.non_null >= 50 AND s.q3 - s.q1 > 0 AND o.o * 1.0 / s.non_null > 0.05 ORDER BY position LIMIT 1)"""


@register("profile_warnings", WARNINGS_SQL)
def q_profile_warnings(spark, sf_dir):
    return rnd(P.warnings(lineitem_nulls(spark, sf_dir)), {"value": 6})


def _findings_sql(src, cols):
    parts = []
    for i, (n, d) in enumerate(cols):
        parts.append(f"""SELECT 'constant' AS finding, '{n}' AS "column", {i} AS position FROM {src}
  HAVING count(DISTINCT {n}) + CASE WHEN count({n}) < count(*) THEN 1 ELSE 0 END <= 1""")
        if d in ("bigint", "int", "string"):
            parts.append(f"""SELECT 'potential_id', '{n}', {i} FROM {src}
  HAVING count(*) > 0 AND count(DISTINCT {n}) = count(*)""")
        low = n.lower()
        if "date" in low or "time" in low:
            ok = f"{n} IS NOT NULL" if d != "string" else f"try_strptime({n}, '%Y-%m-%d %H:%M:%S') IS NOT NULL"
            parts.append(f"""SELECT 'datetime_like', '{n}', {i} FROM {src}
  HAVING avg(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END) >= 0.8""")
    return "\nUNION ALL\n".join(parts)


@register("schema_findings", "WITH t AS " + LINEITEM_NULLS_SQL + "\n" + _findings_sql("t", LINEITEM_COLUMNS))
def q_schema_findings(spark, sf_dir):
    return P.schema_findings(lineitem_nulls(spark, sf_dir))


CUSTOMER_COLUMNS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                    ("c_acctbal", "double"), ("c_mktsegment", "string")]


@register("schema_findings_customer", _findings_sql("customer", CUSTOMER_COLUMNS))
def q_schema_findings_customer(spark, sf_dir):
    return P.schema_findings(table(spark, sf_dir, "customer"))


@register("missing_top20", "WITH t AS " + LINEITEM_NULLS_SQL + "\n" + "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"""SELECT {i} AS position, '{n}' AS "column", round((count(*) - count({n})) * 100.0 / count(*), 6) AS missing_pct
FROM t""" for i, (n, _) in enumerate(LINEITEM_COLUMNS)) + ") ORDER BY missing_pct DESC, position LIMIT 20")
def q_missing_top(spark, sf_dir):
    return rnd(P.missing_top(lineitem_nulls(spark, sf_dir), 20), {"missing_pct": 6})


@register("histogram_extendedprice", """
WITH x AS (SELECT l_extendedprice AS v FROM lineitem),
 m AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
 c AS (SELECT CASE WHEN m.hi = m.lo THEN 1
                   ELSE least(CAST(floor((v - m.lo) / ((m.hi - m.lo) / 30)) AS INTEGER) + 1, 30) END AS bin,
              count(*) AS n FROM x, m GROUP BY 1)
SELECT g.bin, round(m.lo + (g.bin - 1) * (m.hi - m.lo) / 30, 4) AS lo, round(m.lo + g.bin * (m.hi - m.lo) / 30, 4) AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM m, (SELECT unnest(range(1, 31)) AS bin) g LEFT JOIN c ON c.bin = g.bin""")
def q_histogram(spark, sf_dir):
    h = P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30)
    return rnd(h.select(F.col("bin").cast("int").alias("bin"), "lo", "hi", "count"), {"lo": 4, "hi": 4})


TOPV_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@register("top_values_orders", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({n} AS VARCHAR)) AS INTEGER) AS rank,
  CAST({n} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count FROM orders WHERE {n} IS NOT NULL GROUP BY {n}"""
    for n in TOPV_COLS) + ") WHERE rank <= 10")
def q_top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "orders"), TOPV_COLS, 10)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("correlation_pairs", "WITH t AS " + LINEITEM_NULLS_SQL + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM t"""
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def q_correlation(spark, sf_dir):
    cl = P.correlation_long(lineitem_nulls(spark, sf_dir), CORR_COLS)
    return rnd(cl.select("col_a", "col_b", "corr"), {"corr": 6})


@register("high_corr_pairs", """
SELECT * FROM (""" + "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {DESIGN_MATRIX_SQL}"""
    for i, a in enumerate(["rf_a", "rf_n", "rf_r", "ls_f", "l_quantity"])
    for b in ["rf_a", "rf_n", "rf_r", "ls_f", "l_quantity"][i + 1:]) + ") WHERE abs(corr) > 0.3")
def q_high_corr(spark, sf_dir):
    from tabsmith.plans.fixtures import design_matrix
    cols = ["rf_a", "rf_n", "rf_r", "ls_f", "l_quantity"]
    hc = P.high_correlation_pairs(design_matrix(spark, sf_dir), 0.3, cols)
    return rnd(hc.select("col_a", "col_b", "corr"), {"corr": 6})


@register("summary_counts", f"""
WITH t AS {LINEITEM_NULLS_SQL}
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns, CAST(8 AS BIGINT) AS numeric_columns,
  CAST(2 AS BIGINT) AS categorical_columns, CAST({_MISSING_CELLS} AS BIGINT) AS missing_count,
  CAST((SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM t GROUP BY ALL_COLS)) AS BIGINT) AS duplicates
FROM t""".replace("ALL_COLS", _ALL))
def q_summary_counts(spark, sf_dir):
    return P.summary_counts(lineitem_nulls(spark, sf_dir))


@register("missing_indicator", f"""
WITH t AS {LINEITEM_NULLS_SQL}
SELECT l_orderkey, l_linenumber, CAST(l_quantity IS NULL AS INTEGER) AS m_quantity,
  CAST(l_extendedprice IS NULL AS INTEGER) AS m_price, CAST(l_returnflag IS NULL AS INTEGER) AS m_flag FROM t""")
def q_missing_indicator(spark, sf_dir):
    df = lineitem_nulls(spark, sf_dir)
    mi = P.missing_indicator(df.select("l_quantity", "l_extendedprice", "l_returnflag"))
    keys = df.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return keys.select("l_orderkey", "l_linenumber",
                       F.col("l_quantity").isNull().cast("int").alias("m_quantity"),
                       F.col("l_extendedprice").isNull().cast("int").alias("m_price"),
                       F.col("l_returnflag").isNull().cast("int").alias("m_flag")) if mi is not None else None


DETECT_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"),
               ("o_orderpriority", "string")]


def _detect_sql():
    stats = " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{n}' AS name, {str(d in ('bigint', 'int')).upper()} AS is_int,
  {str(d == 'string').upper()} AS is_str, {str(d in NUMERIC_DT).upper()} AS is_num,
  count(DISTINCT {n}) AS uniq, count(DISTINCT {n}) + CASE WHEN count({n}) < count(*) THEN 1 ELSE 0 END AS uniq_all,
  count(*) AS rows, {'min(CAST(' + n + ' AS DOUBLE))' if d in NUMERIC_DT else 'NULL'} AS mn,
  {'max(CAST(' + n + ' AS DOUBLE))' if d in NUMERIC_DT else 'NULL'} AS mx FROM orders"""
        for i, (n, d) in enumerate(DETECT_COLS))
    last = len(DETECT_COLS) - 1
    return f"""WITH s AS ({stats}),
 lastc AS (SELECT * FROM s WHERE pos = {last}),
 pt AS (SELECT CASE WHEN (SELECT (is_int OR is_str OR uniq_all <= 1) FROM lastc)
                    THEN coalesce((SELECT name FROM s WHERE NOT uniq_all <= 1 AND NOT (is_int OR is_str)
                                   ORDER BY pos DESC LIMIT 1), (SELECT name FROM lastc))
                    ELSE (SELECT name FROM lastc) END AS profile_target),
 tt AS (SELECT (SELECT name FROM s WHERE NOT uniq_all <= 1 AND NOT (rows > 0 AND uniq = rows AND (is_int OR is_str))
                ORDER BY pos DESC LIMIT 1) AS task_target),
 p AS (SELECT s.* FROM s, pt WHERE s.name = pt.profile_target),
 t AS (SELECT s.* FROM s, tt WHERE s.name = tt.task_target)
SELECT pt.profile_target, tt.task_target,
  (SELECT CASE WHEN rows = 0 THEN 'clustering' WHEN is_num AND uniq <= 20 THEN 'classification'
               WHEN is_num THEN 'regression' ELSE 'classification' END FROM p) AS problem_type,
  (SELECT CASE WHEN is_num AND (uniq <= 20 OR uniq / rows <= 0.05) THEN 'classification'
               WHEN is_num THEN 'regression' ELSE 'classification' END FROM t) AS task,
  (SELECT CASE WHEN NOT is_num OR uniq <= 20 OR uniq / rows <= 0.05
               THEN CASE WHEN uniq = 2 THEN 'binary' ELSE 'multiclass' END END FROM t) AS classification_type,
  (SELECT CASE WHEN is_num AND NOT (uniq <= 20 OR uniq / rows <= 0.05) THEN ['RMSE', 'MAE', 'R2']
               ELSE ['Accuracy', 'F1', 'AUC'] END FROM t) AS metrics,
  (SELECT uniq FROM t) AS nunique_target,
  (SELECT CASE WHEN is_num AND NOT (uniq <= 20 OR uniq / rows <= 0.05) THEN mn END FROM t) AS target_min,
  (SELECT CASE WHEN is_num AND NOT (uniq <= 20 OR uniq / rows <= 0.05) THEN mx END FROM t) AS target_max
FROM pt, tt"""


@register("detect_task_orders", _detect_sql())
def q_detect_task(spark, sf_dir):
    """PR11-PR15: profile / task target suggestion, problem type, task, metrics and target range."""
    o = table(spark, sf_dir, "orders").select(*[n for n, _ in DETECT_COLS])
    return P.detect_task(o)


@register("column_kind_numeric", "WITH t AS " + LINEITEM_NULLS_SQL + "\n" + "\nUNION ALL\n".join(
    f"""SELECT {i} AS position, '{n}' AS "column" FROM (SELECT 1) x""" for i, (n, d) in enumerate(LINEITEM_COLUMNS)
    if d in NUMERIC_DT))
def q_column_kind(spark, sf_dir):
    st = P.column_stats(lineitem_nulls(spark, sf_dir))
    return P.columns_of_kind(st, "Numeric").select("position", "column")


@register("target_samples", """SELECT value FROM (SELECT DISTINCT o_orderpriority AS value FROM orders)
ORDER BY value LIMIT 3""")
def q_target_samples(spark, sf):
    """PR15: three sample target values (smallest first)."""
    return P.target_samples(table(spark, sf, "orders"), "o_orderpriority", 3)


_PLANS = [  # (plan, step, operation, params, needs missing values), by hand from the documented rules
    ("profile", 0, "impute", '{"columns": [], "strategy": "mean"}', True),
    ("profile", 1, "encode", '{"columns": [], "method": "onehot"}', False),
    ("profile", 2, "scale", '{"columns": [], "method": "standard"}', False),
    ("smart", 0, "impute", '{"columns": [], "strategy": "mean"}', True),
    ("smart", 1, "encode", '{"columns": [], "handle_unknown": "ignore", "max_categories": 50, "method": "onehot", "target": "l_returnflag"}', False),
    ("smart", 2, "scale", '{"columns": [], "method": "standard", "scope": "exclude_binary", "target": "l_returnflag"}', False),
    ("smart", 3, "outliers", '{"method": "iqr", "multiplier": 1.5, "target": "l_returnflag"}', False)]


@register("recommended_steps", "WITH t AS " + LINEITEM_NULLS_SQL + ", m AS (SELECT count(*) AS gaps FROM t WHERE "
          + " OR ".join(f"{n} IS NULL" for n, _ in LINEITEM_COLUMNS) + ")\n" + "\nUNION ALL\n".join(
              f"SELECT '{plan}' AS plan, {step} AS step, '{op}' AS operation, '{params}' AS params FROM m"
              + (" WHERE gaps > 0" if gaps else "") for plan, step, op, params, gaps in _PLANS))
def q_recommended(spark, sf):
    """PR16 / PR17: recommended and smart preprocessing plans from the column profile."""
    import json
    st = P.column_stats(lineitem_nulls(spark, sf)).collect()        # one row per column
    rows = [("profile", i, s["operation"], json.dumps(s["params"], sort_keys=True))
            for i, s in enumerate(P.recommended_steps(st))]
    rows += [("smart", i, s["operation"], json.dumps(s["params"], sort_keys=True))
             for i, s in enumerate(P.smart_plan(st, "l_returnflag", "classification"))]
    return spark.createDataFrame(rows, "plan string, step int, operation string, params string")
