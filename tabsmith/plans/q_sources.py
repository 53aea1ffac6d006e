"""Source / sink / run-table queries (S*, SC3) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.columns import epoch_seconds
from tabsmith.sources import io as IO
from tabsmith.sources import runs as RUNS
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import table

ORDERS_NUM = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double")]
ORDERS_ALL = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
              ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _info_sql():
    parts = []
    for i, (n, d) in enumerate(ORDERS_ALL):
        num = d in ("bigint", "double")
        x = f"CAST({n} AS DOUBLE)"
        st = (lambda e, k: f"round({e}, {k})") if num else (lambda e, k: "CAST(NULL AS DOUBLE)")
        parts.append(f"""SELECT {i} AS position, '{n}' AS "column", '{d}' AS dtype, count({n}) AS count,
  count(*) - count({n}) AS nulls, {st(f'avg({x})', 4)} AS mean, {st(f'stddev_samp({x})', 4)} AS std,
  {st(f'min({x})', 4)} AS min, {st(f'max({x})', 4)} AS max, {st(f'quantile_cont({x}, 0.25)', 4)} AS p25,
  {st(f'quantile_cont({x}, 0.5)', 4)} AS p50, {st(f'quantile_cont({x}, 0.75)', 4)} AS p75 FROM orders""")
    return "\nUNION ALL\n".join(parts)


@register("data_info_orders", _info_sql())
def q_info(spark, sf):
    """S3 read + S8 describe."""
    d = IO.data_info(IO.read_parquet(spark, f"{sf}/orders.parquet"))
    return rnd(d, {k: 4 for k in ("mean", "std", "min", "max", "p25", "p50", "p75")})


@register("head_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8")
def q_head(spark, sf):
    """Ordered preview (8 rows)."""
    return IO.head(table(spark, sf, "orders"), 8, "o_orderkey")


def _run_events(spark, sf):
    """Run lifecycle events derived from ``events``: one run per user, one event per row."""
    ev = table(spark, sf, "events")
    return ev.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
                     epoch_seconds(F.col("ts")).alias("created_at"), epoch_seconds(F.col("ts")).alias("event_ts"),
                     F.col("event_id").alias("seq"), F.lit("regression").alias("task_type"),
                     F.lit("reg_linear").alias("algorithm_key"), F.lit("Linear Regression").alias("model_name"),
                     F.col("event_type").alias("status"), F.col("props").alias("metrics_json"),
                     F.lit("{}").alias("params_json"), F.lit(None).cast("string").alias("artifact_path"))


@register("runs_latest", """SELECT run_id, status, seq FROM (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, event_type AS status, event_id AS seq,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) DESC, event_id DESC) AS rk FROM events) WHERE rk = 1""")
def q_runs_latest(spark, sf):
    """Latest state per run."""
    return RUNS.latest_runs(_run_events(spark, sf)).select("run_id", "status", "seq")


@register("runs_list", """SELECT run_id, status FROM (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, event_type AS status, epoch(ts) AS created_at,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) DESC, event_id DESC) AS rk FROM events)
WHERE rk = 1 ORDER BY created_at DESC, run_id LIMIT 20""")
def q_runs_list(spark, sf):
    """Newest 20 runs."""
    return RUNS.list_runs(_run_events(spark, sf), 20).select("run_id", "status")


@register("prefs_latest", """SELECT user_id, prefs_json FROM (
  SELECT role AS user_id, text AS prefs_json, row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id DESC) AS rk
  FROM conversations) WHERE rk = 1""")
def q_prefs(spark, sf):
    """Last write wins per user (preference writes derived from ``conversations``)."""
    cv = table(spark, sf, "conversations")
    prefs = cv.select(F.col("role").alias("user_id"), F.col("turn").cast("double").alias("updated_at"),
                      F.col("conv_id").alias("seq"), F.col("text").alias("prefs_json"))
    return RUNS.latest_prefs(prefs).select("user_id", "prefs_json")


@register("run_metrics_map", """SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  'k=' || format('{:,.4f}', CAST(json_extract(props, '$.k') AS DOUBLE)) AS metrics_text FROM events""")
def q_run_metrics(spark, sf):
    """SC3: metrics JSON of every run event -> map (its one entry k) and 'k=v' text."""
    return RUNS.run_metrics(_run_events(spark, sf)).select("run_id", F.element_at("metrics", "k").alias("k"), "metrics_text")


def _scratch(spark, stem, ext):
    """A fresh path in the shared checkpoint folder (never a machine-local temp folder)."""
    import os
    import uuid
    from tabsmith.session import checkpoint_dir
    base = checkpoint_dir(spark)
    base = base[len("file:"):] if base.startswith("file:") else base
    return os.path.join(base, "tabsmith-io", f"{stem}-{uuid.uuid4().hex}{ext}")


@register("csv_roundtrip_orders", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total,
  min(o_orderkey) AS first_key FROM orders GROUP BY 1""")
def q_csv(spark, sf):
    """S6 -> S4 / S1: orders written as CSV to the shared folder, loaded back with NA tokens and type inference."""
    path = _scratch(spark, "orders", ".csv")
    IO.export(table(spark, sf, "orders"), path, "csv")
    back = IO.load(spark, path)
    return rnd(back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"),
                                                 F.min("o_orderkey").alias("first_key")), {"total": 2})


@register("json_roundtrip_customer", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS bal
  FROM customer GROUP BY 1""")
def q_json(spark, sf):
    """S6 -> S2: customer written as JSON records and read back."""
    path = _scratch(spark, "customer", ".json")
    IO.export(table(spark, sf, "customer"), path, "json")
    back = IO.read_json(spark, path, multi_line=False)
    return rnd(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("bal")),
               {"bal": 4})
