"""Table profiling (PR1-PR28).

Plan shape: one wide aggregate for counts and moments of every column
(partial + final hash aggregate, one row out), one long ``(column, value,
cnt)`` distinct table for distinct counts / quantiles / top values (hot values
collapse map-side), and small per-column result tables built from those.
Nothing is sampled: the reference profiles a 50 000-row sample of large
tables, we profile all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsmith.functions.columns import (c, is_datetime, is_integral, is_numeric, is_string, kind,
                                        nan_to_null, q)
from tabsmith.functions.correlation import correlation_matrix
from tabsmith.functions.stats import (kurtosis_bias_corrected, quantiles, skew_bias_corrected,
                                      value_counts)

STAT_SCHEMA = ("position int, column string, dtype string, kind string, is_numeric boolean, "
               "is_integral boolean, is_string boolean, is_datetime boolean")


def _meta(df: DataFrame) -> list[tuple]:
    out = []
    for i, f in enumerate(df.schema.fields):
        dt = f.dataType
        name = "timestamp" if isinstance(dt, T.TimestampNTZType) else dt.simpleString()
        out.append((i, f.name, name, kind(dt), is_numeric(dt, include_bool=True),
                    is_integral(dt), is_string(dt), is_datetime(dt)))
    return out


def _num(x):
    return c(x).cast("double")


# ------------------------------------------------------------------ PR1-PR3

def duplicate_count(df: DataFrame) -> DataFrame:
    """PR2: rows beyond the first occurrence (nulls compare equal, like pandas)."""
    g = df.groupBy(*[c(x) for x in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def overview(df: DataFrame) -> DataFrame:
    """PR1 + PR2 + PR3: rows, columns, missing cells, missing %, duplicates, quality score."""
    df = nan_to_null(df)
    ncols = len(df.columns)
    missing = sum((F.count_if(c(x).isNull()) for x in df.columns), F.lit(0)) if ncols else F.lit(0)
    base = df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("bigint").alias("missing_count"))
    dups = duplicate_count(df).first()["duplicates"]          # one number
    total = F.col("rows") * F.lit(ncols)
    missing_pct = F.when(total > 0, F.col("missing_count") * 100.0 / total).otherwise(F.lit(0.0))
    out = base.select(
        F.col("rows").cast("bigint").alias("rows"), F.lit(ncols).cast("bigint").alias("columns"),
        "missing_count", missing_pct.alias("missing_pct"), F.lit(dups).cast("bigint").alias("duplicates"))
    score = (F.lit(100.0) - F.least(F.lit(60.0), F.col("missing_pct") * 1.5)
             - F.when(F.col("rows") > 0, F.least(F.lit(25.0), F.col("duplicates") * 100.0 / F.col("rows")))
             .otherwise(F.lit(0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    band = F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("poor")
    return out.withColumn("quality_score", score).withColumn("quality_band", band)


# ------------------------------------------------------------------ PR4, PR5, PR27

def column_stats(df: DataFrame, approx: bool = False, with_quantiles: bool = True) -> DataFrame:
    """PR4/PR5/PR27: one row per column.

    ``unique`` = distinct non-null; ``missing_pct``; for numeric columns (bool
    counts as numeric, like pandas): mean, median, min, max, std (ddof 1),
    variance (ddof 1), skew and kurtosis (pandas bias-corrected); q1/q3;
    ``cardinality_ratio`` = unique / rows.
    """
    df = nan_to_null(df)
    meta = _meta(df)
    numeric = [m[1] for m in meta if m[4]]
    other = [m[1] for m in meta if not m[4]]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, m in enumerate(meta):
        aggs.append(F.count(c(m[1])).alias(f"nn{i}"))
        if m[4]:
            x = _num(m[1])
            aggs += [F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                     F.stddev_samp(x).alias(f"std{i}"), F.var_samp(x).alias(f"var{i}"),
                     skew_bias_corrected(x).alias(f"skew{i}"), kurtosis_bias_corrected(x).alias(f"kurt{i}")]
    wide = df.agg(*aggs)
    nul = F.lit(None).cast("double")
    structs = []
    for i, m in enumerate(meta):
        g = (lambda k: F.col(f"{k}{i}")) if m[4] else (lambda k: nul)
        structs.append(F.struct(
            F.lit(i).alias("position"), F.lit(m[1]).alias("column"), F.lit(m[2]).alias("dtype"),
            F.lit(m[3]).alias("kind"), F.lit(m[4]).alias("is_numeric"), F.lit(m[5]).alias("is_integral"),
            F.lit(m[6]).alias("is_string"), F.lit(m[7]).alias("is_datetime"),
            F.col("__rows").alias("rows"), F.col(f"nn{i}").alias("non_null"),
            g("mean").alias("mean"), g("min").alias("min"), g("max").alias("max"),
            g("std").alias("std"), g("var").alias("variance"), g("skew").alias("skew"),
            g("kurt").alias("kurtosis")))
    stats = wide.select(F.inline(F.array(*structs)))
    # distinct counts from the distinct-value tables (no Expand of count_distinct); datetimes are
    # counted as epoch microseconds (cheap) and strings as text
    parts = []
    if numeric:
        parts.append(value_counts(df, numeric, "double"))
    dts = [m[1] for m in meta if m[7]]
    txt = [x for x in other if x not in dts]
    if dts:
        as_micros = df.select(*[F.unix_micros(c(x).cast("timestamp")).alias(x) for x in dts])
        parts.append(value_counts(as_micros, dts, "bigint").select("column", "cnt"))
    if txt:
        parts.append(value_counts(df, txt, "string").select("column", "cnt"))
    distinct = None
    for p in parts:
        d = p.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("unique"))
        distinct = d if distinct is None else distinct.unionByName(d)
    out = stats.join(distinct, "column", "left") if distinct is not None else stats.withColumn("unique", F.lit(0))
    if numeric and with_quantiles:
        qs = quantiles(df, numeric, [0.25, 0.5, 0.75], approx=approx)
        qw = qs.groupBy("column").agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
        out = out.join(qw, "column", "left")
    else:
        out = out.withColumn("q1", nul).withColumn("median", nul).withColumn("q3", nul)
    rows = F.col("rows")
    out = out.select(
        "position", "column", "dtype", "kind", "is_numeric", "is_integral", "is_string", "is_datetime",
        "rows", "non_null", F.coalesce(F.col("unique"), F.lit(0)).cast("bigint").alias("unique"),
        F.when(rows > 0, (rows - F.col("non_null")) * 100.0 / rows).otherwise(F.lit(0.0)).alias("missing_pct"),
        "mean", "median", "min", "max", "std", "variance", "skew", "kurtosis", "q1", "q3",
        F.when(rows > 0, F.coalesce(F.col("unique"), F.lit(0)) / rows).alias("cardinality_ratio"))
    return out


def top_values(df: DataFrame, columns=None, k: int = 10, salt_buckets: int | None = None) -> DataFrame:
    """PR5 / PR20: the k most frequent values per column (ties -> smaller value).

    Two-stage top-k: rank inside (column, hash-bucket) groups, keep <= k per
    bucket, then rank the survivors.  No window ever holds all distinct
    values of a column in one task.
    """
    df = nan_to_null(df)
    columns = list(columns or df.columns)
    b = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vc = value_counts(df, columns, "string")
    order = [F.col("cnt").desc(), F.col("value").asc()]
    stage1 = (vc.withColumn("__b", F.pmod(F.xxhash64("value"), F.lit(b)))
              .withColumn("__r", F.row_number().over(Window.partitionBy("column", "__b").orderBy(*order)))
              .where(F.col("__r") <= k))
    stage2 = stage1.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return stage2.where(F.col("rank") <= k).select("column", "rank", "value", F.col("cnt").cast("bigint").alias("count"))


# ------------------------------------------------------------------ PR6-PR9

def warnings(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """PR6-PR9 as rows ``(warning, column, value)``.

    high_missing: every column with missing > 20 %; skewed: first numeric
    column (schema order) with n >= 30 and |skew| > 1; categorical: count of
    string columns; outliers: first numeric column with n >= 50, IQR > 0 and
    > 5 % of values outside 1.5 IQR.  The outlier pass inlines the collected
    quartiles (one pair per column) as literals -- no join.
    """
    df = nan_to_null(df)
    stats = stats if stats is not None else column_stats(df)
    st = stats.persist()
    hm = st.where(F.col("missing_pct") > 20.0).select(
        F.lit("high_missing").alias("warning"), "column", F.col("missing_pct").alias("value"), "position")
    sk = (st.where(F.col("is_numeric") & (F.col("non_null") >= 30) & (F.abs(F.col("skew")) > 1.0))
          .orderBy("position").limit(1)
          .select(F.lit("skewed").alias("warning"), "column", F.col("skew").alias("value"), "position"))
    cat = (st.where(F.col("is_string")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
           .select(F.lit("categorical").alias("warning"), F.lit(None).cast("string").alias("column"),
                   F.col("n").cast("double").alias("value"), F.lit(10_000).alias("position")))
    bounds = st.where(F.col("is_numeric") & (F.col("non_null") >= 50) & ((F.col("q3") - F.col("q1")) > 0)) \
        .select("position", "column", "q1", "q3", "non_null").collect()
    parts = [hm, sk, cat]
    if bounds:
        counts = []
        for r in bounds:
            iqr = r["q3"] - r["q1"]
            lo, hi = r["q1"] - 1.5 * iqr, r["q3"] + 1.5 * iqr
            x = _num(r["column"])
            counts.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{r['position']}"))
        orow = df.agg(*counts)
        structs = [F.struct(F.lit(r["position"]).alias("position"), F.lit(r["column"]).alias("column"),
                            F.col(f"o{r['position']}").cast("double").alias("value"),
                            F.lit(float(r["non_null"])).alias("n")) for r in bounds]
        ol = orow.select(F.inline(F.array(*structs)))
        ol = (ol.where(F.col("value") / F.col("n") > 0.05).orderBy("position").limit(1)
              .select(F.lit("outliers").alias("warning"), "column", "value", "position"))
        parts.append(ol)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("warning", "column", "value")


# ------------------------------------------------------------------ PR10

def _datetime_name(name: str) -> bool:
    n = name.lower()
    return "date" in n or "time" in n


def schema_findings(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """PR10: rows ``(finding, column)``.

    constant: <= 1 distinct value counting null as a value; potential_id: all
    rows distinct and integral or string; datetime_like: name holds
    date/time and >= 80 % of rows parse as a timestamp; inconsistent_type:
    string column whose values fall in more than one parse class (integer,
    decimal, timestamp, text) -- the reference's "mixed Python types" re-aimed
    for typed columns, over all values.
    """
    df = nan_to_null(df)
    st = (stats if stats is not None else column_stats(df, with_quantiles=False)).persist()   # one row per column
    meta = {m[1]: m for m in _meta(df)}
    const = st.where((F.col("unique") + F.when(F.col("non_null") < F.col("rows"), 1).otherwise(0)) <= 1) \
        .select(F.lit("constant").alias("finding"), "column", "position")
    pid = st.where((F.col("rows") > 0) & (F.col("unique") == F.col("rows"))
                   & (F.col("is_integral") | F.col("is_string"))) \
        .select(F.lit("potential_id").alias("finding"), "column", "position")
    parts = [const, pid]
    dt_cols = [n for n in df.columns if _datetime_name(n)]
    strings = [n for n in df.columns if meta[n][6]]
    # parse classes depend only on the value: evaluate them once per distinct string (count-weighted)
    if strings:
        v = F.col("value")
        cls = (F.when(F.expr("try_cast(value as bigint)").isNotNull(), F.lit(1))
               .when(F.expr("try_cast(value as double)").isNotNull(), F.lit(2))
               .when(F.expr("try_to_timestamp(value)").isNotNull(), F.lit(4))
               .otherwise(F.lit(8)))
        per = value_counts(df, strings, "string").select("column", "cnt", cls.alias("cls"))
        agg = per.groupBy("column").agg(F.bit_or("cls").alias("bits"),
                                        F.sum(F.when(F.col("cls") == 4, F.col("cnt")).otherwise(0)).alias("ts_ok"))
        info = {r["column"]: r for r in agg.collect()}          # one row per string column
        del v
    else:
        info = {}
    rows_n = st.select("rows").first()[0] if df.columns else 0
    found = []
    for n in dt_cols:
        m = meta[n]
        if m[7] or m[4]:
            ok = st.where(F.col("column") == n).select("non_null").first()[0]   # datetimes / numbers parse
        elif m[6]:
            r = info.get(n)
            ok = (r["ts_ok"] if r else 0)
        else:
            ok = 0
        if rows_n and ok / rows_n >= 0.8:
            found.append(("datetime_like", n, m[0]))
    for n in strings:
        r = info.get(n)
        if r is not None and bin(int(r["bits"])).count("1") > 1:
            found.append(("inconsistent_type", n, meta[n][0]))
    if found:
        parts.append(df.sparkSession.createDataFrame(found, "finding string, column string, position int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("finding", "column", "position")


# ------------------------------------------------------------------ PR11-PR15

def _last_by_position(df: DataFrame, cond) -> DataFrame:
    return df.where(cond).orderBy(F.col("position").desc()).limit(1)


def detect_task(df: DataFrame, target: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """PR11-PR15 in one row.

    profile_target (PR11): last column unless it looks like an ID
    (int/string dtype) or is constant, else the last column that is neither,
    else the last column.  task_target (PR12): last column that is not
    constant and not a unique int/string.  problem_type (PR13) and task
    (PR14) follow the two rule sets of the reference; PR15 target range.
    """
    df = nan_to_null(df)
    spark = df.sparkSession
    st = (stats if stats is not None else column_stats(df, with_quantiles=False)).persist()
    ncols = len(df.columns)
    if ncols == 0:
        return spark.createDataFrame([(None, None, "clustering", "clustering", None, None, None, None, None)],
                                     "profile_target string, task_target string, problem_type string, task string,"
                                     " classification_type string, metrics array<string>, nunique_target long,"
                                     " target_min double, target_max double")
    nunique_all = F.col("unique") + F.when(F.col("non_null") < F.col("rows"), 1).otherwise(0)
    looks_id = F.col("is_integral") | F.col("is_string")
    last = st.where(F.col("position") == ncols - 1)
    bad_last = last.where(looks_id | (nunique_all <= 1)).count() > 0
    if target is not None and target in df.columns:
        prof_t = target
    elif not bad_last:
        prof_t = df.columns[-1]
    else:
        r = _last_by_position(st, ~(nunique_all <= 1) & ~looks_id).select("column").first()
        prof_t = r[0] if r else df.columns[-1]
    if target is not None and target in df.columns:
        task_t = target
    else:
        unique_id = (F.col("rows") > 0) & (F.col("unique") == F.col("rows")) & looks_id
        r = _last_by_position(st, ~(nunique_all <= 1) & ~unique_id).select("column").first()
        task_t = r[0] if r else None
    has_dt = st.where(F.col("is_datetime")).count() > 0
    if not has_dt:
        # name holds date/time and >= 80 % parse (see schema_findings)
        has_dt = schema_findings(df, st).where(F.col("finding") == "datetime_like").count() > 0
    rows = {r["column"]: r for r in st.where(F.col("column").isin([x for x in (prof_t, task_t) if x]))
            .collect()}
    n_rows = st.select("rows").first()[0] if ncols else 0
    # PR13
    pr = rows.get(prof_t)
    if n_rows == 0 or pr is None:
        problem = "clustering"
    elif pr["is_numeric"]:
        problem = "classification" if pr["unique"] <= 20 else "regression"
    else:
        problem = "classification"
    # PR14
    tr = rows.get(task_t)
    cls_type = None
    metrics = []
    nunique = None
    tmin = tmax = None
    if n_rows == 0 or tr is None:
        task = "clustering"
    else:
        nunique = int(tr["unique"])
        if tr["is_numeric"] and has_dt:
            task, metrics = "time_series", ["RMSE", "MAE", "R2"]
        elif tr["is_numeric"] and (nunique <= 20 or nunique / max(1, n_rows) <= 0.05):
            task, metrics = "classification", ["Accuracy", "F1", "AUC"]
            cls_type = "binary" if nunique == 2 else "multiclass"
        elif tr["is_numeric"]:
            task, metrics = "regression", ["RMSE", "MAE", "R2"]
            tmin, tmax = tr["min"], tr["max"]
        else:
            task, metrics = "classification", ["Accuracy", "F1", "AUC"]
            cls_type = "binary" if nunique == 2 else "multiclass"
    st.unpersist()
    # one row, built from aggregates of the data
    return spark.createDataFrame(
        [(prof_t, task_t, problem, task, cls_type, metrics, nunique, tmin, tmax)],
        "profile_target string, task_target string, problem_type string, task string, "
        "classification_type string, metrics array<string>, nunique_target long, "
        "target_min double, target_max double")


def target_samples(df: DataFrame, target: str, k: int = 3, order_by=None) -> DataFrame:
    """PR15: k sample distinct target values (deterministic: smallest first)."""
    x = c(target)
    return df.where(x.isNotNull()).select(x.cast("string").alias("value")).distinct().orderBy("value").limit(k)


# ------------------------------------------------------------------ PR16-PR17, PR24

def recommended_steps(stats_rows) -> list[dict]:
    """PR16: step spec from the (collected, one-per-column) stats rows."""
    steps = []
    if any(r["missing_pct"] > 0 for r in stats_rows):
        steps.append({"operation": "impute", "params": {"columns": [], "strategy": "mean"}})
    if any(r["is_string"] for r in stats_rows):
        steps.append({"operation": "encode", "params": {"columns": [], "method": "onehot"}})
    if any(r["is_numeric"] for r in stats_rows):
        steps.append({"operation": "scale", "params": {"columns": [], "method": "standard"}})
    return steps


def smart_plan(stats_rows, target: str | None = None, task: str | None = None) -> list[dict]:
    """PR17: the reference's "smart preprocess" rules as a step spec."""
    steps = []
    missing = [r["column"] for r in stats_rows if r["missing_pct"] > 0]
    if missing:
        steps.append({"name": "impute", "operation": "impute",
                      "params": {"columns": [], "strategy": "mean"}})
    cats = [r["column"] for r in stats_rows if r["is_string"] and r["column"] != target]
    if cats:
        steps.append({"name": "encode", "operation": "encode",
                      "params": {"columns": [], "method": "onehot", "max_categories": 50,
                                 "handle_unknown": "ignore", "target": target}})
    nums = [r["column"] for r in stats_rows if r["is_numeric"] and r["column"] != target]
    if nums:
        steps.append({"name": "scale", "operation": "scale",
                      "params": {"columns": [], "method": "standard", "scope": "exclude_binary",
                                 "target": target}})
        steps.append({"name": "outliers", "operation": "outliers",
                      "params": {"method": "iqr", "multiplier": 1.5, "target": target}})
    if len(nums) >= 20:
        steps.append({"name": "corr_filter", "operation": "feature_selection",
                      "params": {"method": "correlation", "threshold": 0.95}})
    if len(nums) >= 30 and target and task in ("classification", "regression"):
        steps.append({"name": "kbest", "operation": "feature_selection",
                      "params": {"method": "select_k_best", "k": 30, "target": target, "task_type": task,
                                 "score_func": "f_classif" if task == "classification" else "f_regression"}})
    return steps


# ------------------------------------------------------------------ PR18-PR23, PR28

def missing_top(df: DataFrame, k: int = 20) -> DataFrame:
    """PR18: missing % per column, top k (ties -> schema order)."""
    df = nan_to_null(df)
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__rows"), *[F.count_if(c(x).isNull()).alias(f"m{i}") for i, x in enumerate(df.columns)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(x).alias("column"),
                        F.when(F.col("__rows") > 0, F.col(f"m{i}") * 100.0 / F.col("__rows"))
                        .otherwise(F.lit(0.0)).alias("missing_pct")) for i, x in enumerate(df.columns)]
    long = row.select(F.inline(F.array(*structs)))
    return long.orderBy(F.col("missing_pct").desc(), "position").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """PR19: equal-width histogram, last bin closed; ``(bin, lo, hi, count)`` for all bins.

    The range is one small aggregate whose two numbers are inlined; counting is
    one ``groupBy(bin)`` (at most ``bins`` groups, partially aggregated per task).
    """
    df = nan_to_null(df)
    x = _num(column)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    lo, hi = float(r["lo"]), float(r["hi"])
    w = (hi - lo) / bins
    b = F.lit(1) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(w)).cast("int") + 1, F.lit(bins))
    counted = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))        # bins rows
    return (grid.join(F.broadcast(counted), "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(w)).alias("lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(w)).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def correlation_long(df: DataFrame, columns=None) -> DataFrame:
    """PR21: pairwise-complete Pearson correlation, long form (a < b), from one blocked pass (``functions.correlation``).

    All-null numeric columns are dropped (the reference drops them before
    ``corr``).  The driver gets p x p numbers; null where a correlation is undefined.
    """
    cols = list(columns) if columns else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    corr, shared = correlation_matrix(df, [_num(x) for x in cols])
    kept = [i for i in range(len(cols)) if shared[i, i] > 0]
    rows = []
    for a, i in enumerate(kept):
        for b in range(a + 1, len(kept)):
            r = float(corr[i, kept[b]])
            rows.append((cols[i], cols[kept[b]], a, b, None if np.isnan(r) else r))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, pos_a int, pos_b int, corr double")


def high_correlation_pairs(df: DataFrame, threshold: float = 0.9, columns=None) -> DataFrame:
    """PR28: pairs with |corr| > threshold."""
    return correlation_long(df, columns).where(F.abs(F.col("corr")) > threshold)


def missing_indicator(df: DataFrame) -> DataFrame:
    """PR22: 0/1 per cell (all rows, no sample)."""
    df = nan_to_null(df)
    return df.select(*[c(x).isNull().cast("int").alias(x) for x in df.columns])


def summary_counts(df: DataFrame) -> DataFrame:
    """PR23: rows, cols, numeric / categorical column counts, missing cells, duplicates."""
    meta = _meta(df)
    ov = overview(df)
    return ov.select("rows", "columns",
                     F.lit(sum(1 for m in meta if m[4])).cast("bigint").alias("numeric_columns"),
                     F.lit(sum(1 for m in meta if m[6])).cast("bigint").alias("categorical_columns"),
                     "missing_count", "duplicates")


def feature_sample_ratio(df: DataFrame) -> DataFrame:
    """PR27: columns per row; null for an empty table."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("samples")).select(F.lit(len(df.columns)).alias("features"), "samples",
                                             F.when(F.col("samples") > 0, F.lit(float(len(df.columns))) / F.col("samples")).alias("feature_to_sample_ratio"))


def columns_of_kind(stats: DataFrame, kind_name: str) -> DataFrame:
    """filter the profile rows by kind (Numeric / Categorical / Datetime / Other)."""
    return stats.where(F.col("kind") == kind_name)
