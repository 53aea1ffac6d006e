"""Exact running sums over a pseudorandom row order, without a one-task window.

The order is ``md5(seed:id)``, then the id, then the value.  A row's bucket is a prefix of its
md5, so the buckets themselves follow the order: the running sum inside a bucket plus the sums of
the buckets before it is the running sum over the whole group, whatever the bucket count.  A
group with a third of all rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: str | Column, seed: int) -> Column:
    """32 hex digits that fix a row's place; null ids count as the text ``null``."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null"))))


def running_start(df: DataFrame, group: str, key: str, value: str, out: str, n_rows: int, seed: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before.

    ``group`` may be null (one more group).  Rows with equal key and value are interchangeable.
    """
    buckets = isqrt(max(0, n_rows)) // 2 + 1  # as many buckets as rows in a bucket, about
    df = df.withColumn("_h", order_hash(key, seed))
    df = df.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * F.lit(buckets)
                                     / F.lit(2 ** 32)).cast("bigint"))
    per = df.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_b2")).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy("_g").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("bigint")).drop("_s")
    inside = (Window.partitionBy(group, "_b").orderBy("_h", key, value)
              .rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("bigint"))
    # one row per group and bucket on the one side, the rows on the other: neither is broadcast
    joined = df.join(per.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_b2")))
    return joined.withColumn(out, F.col("_off") + F.col("_in")).drop("_g", "_b", "_b2", "_off", "_in", "_h")
