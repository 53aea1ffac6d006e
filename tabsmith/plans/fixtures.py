"""Derived test tables, defined once for Spark and once as DuckDB SQL.

Each fixture is the same deterministic expression over the driver's
parquet tables in both engines (see FIXTURES.md section 3).  They process
whole tables; the modulo expressions only choose which cells become null
or which rows are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ nulls

def lineitem_nulls(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax",
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""

LINEITEM_COLUMNS = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp")]


# ------------------------------------------------------------------ dups

def lineitem_dups(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.unionByName(li.where(F.col("l_orderkey") % 10 == 0))


LINEITEM_DUPS_SQL = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)"


# ------------------------------------------------------------------ nonfinite

def events_nonfinite(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    v = (F.when(k % 9 == 0, F.lit(float("nan"))).when(k % 17 == 0, F.lit(float("inf")))
         .otherwise(F.col("value")))
    return ev.select("event_id", "ts", "user_id", "event_type", v.alias("value"))


EVENTS_NONFINITE_SQL = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 = 0 THEN 'inf'::DOUBLE ELSE value END AS value
  FROM events)"""


# ------------------------------------------------------------------ mixed text

def events_mixed_text(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    m = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return ev.select("event_id", m.alias("mixed"), "value")


# ------------------------------------------------------------------ prediction tables

def binary_pred(spark, sf_dir) -> DataFrame:
    """label = returnflag R, score = 10 * discount, prediction = score >= .5."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("score"),
        ((F.col("l_discount") * 10) >= 0.5).cast("int").alias("prediction"))


BINARY_PRED_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10 AS score,
  CAST(l_discount * 10 >= 0.5 AS INTEGER) AS prediction FROM lineitem)"""


def multi_pred(spark, sf_dir) -> DataFrame:
    """label = order priority, prediction = priority picked by orderkey % 5."""
    o = table(spark, sf_dir, "orders")
    pri = F.array(*[F.lit(x) for x in PRIORITIES])
    return o.select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("label"),
                    F.element_at(pri, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("prediction"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

MULTI_PRED_SQL = """(SELECT o_orderkey, o_totalprice, o_orderpriority AS label,
  (['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS prediction
  FROM orders)"""


def reg_pred(spark, sf_dir) -> DataFrame:
    """label = 1000 q + 0.1 price; two rule models m1, m2 in long form (model, label, prediction)."""
    li = table(spark, sf_dir, "lineitem")
    label = F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.1
    base = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     label.alias("label"))
    m1 = base.withColumn("model", F.lit("m1")).withColumn("prediction", F.col("l_quantity") * 1000 + 5250)
    m2 = base.withColumn("model", F.lit("m2")).withColumn(
        "prediction", F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.09)
    return m1.unionByName(m2)


REG_PRED_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
   l_quantity * 1000 + l_extendedprice * 0.1 AS label, 'm1' AS model, l_quantity * 1000 + 5250 AS prediction
   FROM lineitem
 UNION ALL
 SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
   l_quantity * 1000 + l_extendedprice * 0.1 AS label, 'm2' AS model,
   l_quantity * 1000 + l_extendedprice * 0.09 AS prediction FROM lineitem)"""


def labels_pred(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


LABELS_PRED_SQL = "(SELECT doc_id, quality AS label, 1 - toxic AS prediction FROM labels)"


def clusters(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cl = F.when(F.col("p_size") == 50, F.lit(-1)).otherwise(F.col("p_size") % 4)
    return p.select("p_partkey", F.col("p_size").cast("double").alias("x1"),
                    F.col("p_retailprice").alias("x2"), cl.cast("int").alias("cluster"))


CLUSTERS_SQL = """(SELECT p_partkey, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2,
  CAST(CASE WHEN p_size = 50 THEN -1 ELSE p_size % 4 END AS INTEGER) AS cluster FROM part)"""


def group_attr(spark, sf_dir) -> DataFrame:
    """binary predictions joined to the customer's market segment (protected attribute)."""
    bp = binary_pred(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (bp.join(o, bp.l_orderkey == o.o_orderkey)
            .join(cu, o.o_custkey == cu.c_custkey)
            .select("label", "prediction", F.col("c_mktsegment").alias("grp")))


GROUP_ATTR_SQL = f"""(SELECT b.label, b.prediction, c.c_mktsegment AS grp
  FROM {BINARY_PRED_SQL} b JOIN orders o ON b.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""


def design_matrix(spark, sf_dir) -> DataFrame:
    """lineitem numerics + one-hot flags + a regression and a 0/1 target."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "A").cast("double").alias("rf_a"),
        (F.col("l_returnflag") == "N").cast("double").alias("rf_n"),
        (F.col("l_returnflag") == "R").cast("double").alias("rf_r"),
        (F.col("l_linestatus") == "F").cast("double").alias("ls_f"),
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.1).alias("y_reg"),
        ((F.col("l_quantity") + F.col("l_tax") * 100) > 30).cast("int").alias("y_bin"))


DESIGN_MATRIX_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(l_returnflag = 'A' AS DOUBLE) AS rf_a, CAST(l_returnflag = 'N' AS DOUBLE) AS rf_n,
  CAST(l_returnflag = 'R' AS DOUBLE) AS rf_r, CAST(l_linestatus = 'F' AS DOUBLE) AS ls_f,
  l_quantity * 1000 + l_extendedprice * 0.1 AS y_reg,
  CAST(l_quantity + l_tax * 100 > 30 AS INTEGER) AS y_bin FROM lineitem)"""


# ------------------------------------------------------------------ baseline / current

EVENTS_SPLIT = "2024-01-16"
ORDERS_SPLIT = "1998-01-01"


def baseline_current(spark, sf_dir, which: str = "events"):
    if which == "events":
        ev = table(spark, sf_dir, "events").select("ts", "user_id", "value", "event_id")
        cond = F.col("ts") < F.lit(EVENTS_SPLIT).cast("timestamp")
        return ev.where(cond).drop("ts"), ev.where(~cond).drop("ts")
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", "o_custkey", "o_orderkey")
    cond = F.col("o_orderdate") < F.lit(ORDERS_SPLIT).cast("timestamp")
    return o.where(cond).drop("o_orderdate"), o.where(~cond).drop("o_orderdate")
