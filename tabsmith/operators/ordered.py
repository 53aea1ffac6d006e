"""Order-dependent operators without a single-task global window.

The reference interpolates by row position.  Spark rows have no position,
so the caller names an ``order_by`` (and optionally ``partition_by``).  A
window ordered over the whole table would run in one task; instead the
table is range-partitioned on the order, each partition computes its local
nearest-valid neighbours, and a tiny per-partition summary (last / first
valid value with its position) is carried across partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.functions.columns import c
from tabsmith.session import cut_lineage


def _ranged(df: DataFrame, keys, order, partitions=None) -> DataFrame:
    """Range-partition on (keys, order, row hash).

    The row-hash tiebreaker lets the range partitioner split a hot order value
    (say a third of all rows) across many partitions instead of one.
    """
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__tb", F.xxhash64(*[c(x) for x in df.columns]))
    r = d.repartitionByRange(p, *[c(k) for k in keys], *[c(o) for o in order], F.col("__tb")) \
        .withColumn("__pid", F.spark_partition_id())
    return cut_lineage(r)   # partition ids must be stable across the passes below


def positions(df: DataFrame, order, keys=()) -> DataFrame:
    """Add ``__pid`` and ``__pos`` (0-based position within ``keys`` by ``order``), distributed."""
    keys, order = list(keys), list(order)
    r = _ranged(df, keys, order)
    local = Window.partitionBy("__pid", *keys).orderBy(*[c(o) for o in order], "__tb")
    r = r.withColumn("__rn", F.row_number().over(local))
    cnt = r.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"))
    ow = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1) if keys \
        else Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select("__pid", *keys, F.coalesce(F.sum("__n").over(ow), F.lit(0)).alias("__off"))
    # offs: one row per (partition, key group)
    return (r.join(F.broadcast(offs) if not keys else offs, ["__pid", *keys])
            .withColumn("__pos", F.col("__off") + F.col("__rn") - 1).drop("__off", "__rn", "__tb"))


def interpolate_linear(df: DataFrame, columns, order, partition_by=None) -> DataFrame:
    """pandas ``interpolate(method='linear', limit_direction='both')`` by position.

    Interior nulls: linear between the nearest valid neighbours by position;
    leading / trailing nulls take the nearest valid value; an all-null column
    stays null.  Output columns are double.
    """
    keys = list(partition_by or [])
    order = [order] if isinstance(order, str) else list(order)
    cols = [x for x in columns if x in df.columns]
    base = positions(df, order, keys)
    lw = Window.partitionBy("__pid", *keys).orderBy("__pos")
    prev_w = lw.rowsBetween(Window.unboundedPreceding, 0)
    # "next valid" as a running frame over the reversed order: Spark's
    # UNBOUNDED FOLLOWING frame re-scans the rest of the partition per row
    next_w = Window.partitionBy("__pid", *keys).orderBy(F.col("__pos").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    val = lambda x: F.struct(F.col("__pos").alias("p"), c(x).cast("double").alias("v"))
    t = base
    summ = []
    for i, x in enumerate(cols):
        vx = F.when(c(x).isNotNull(), val(x))
        t = (t.withColumn(f"__lp{i}", F.last(vx, ignorenulls=True).over(prev_w))
              .withColumn(f"__ln{i}", F.last(vx, ignorenulls=True).over(next_w)))
        summ += [F.max(vx).alias(f"__sl{i}"), F.min(vx).alias(f"__sf{i}")]
    # per-partition summary -> carries from neighbouring partitions (small table)
    s = base.groupBy("__pid", *keys).agg(*summ)
    cw_prev = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__pid")
    carries = s.select("__pid", *keys, *[
        e for i in range(len(cols)) for e in (
            F.last(f"__sl{i}", ignorenulls=True).over(cw_prev.rowsBetween(Window.unboundedPreceding, -1))
            .alias(f"__cp{i}"),
            F.first(f"__sf{i}", ignorenulls=True).over(cw_prev.rowsBetween(1, Window.unboundedFollowing))
            .alias(f"__cn{i}"))])
    t = t.join(F.broadcast(carries) if not keys else carries, ["__pid", *keys])
    out = []
    for x in df.columns:
        if x not in cols:
            out.append(c(x))
            continue
        i = cols.index(x)
        prev = F.coalesce(F.col(f"__lp{i}"), F.col(f"__cp{i}"))
        nxt = F.coalesce(F.col(f"__ln{i}"), F.col(f"__cn{i}"))
        lerp = prev["v"] + (nxt["v"] - prev["v"]) * (F.col("__pos") - prev["p"]) / (nxt["p"] - prev["p"])
        filled = (F.when(c(x).isNotNull(), c(x).cast("double"))
                  .when(prev.isNotNull() & nxt.isNotNull(), lerp)
                  .when(prev.isNotNull(), prev["v"])
                  .otherwise(nxt["v"]))
        out.append(filled.alias(x))
    return t.select(*out)
