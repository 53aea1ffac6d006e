"""Explicit range partitions, for operators whose rows need their neighbours in sort order.

The boundaries come from a sample of keys (about ``PER_PART`` per partition, ``MOST`` in all), taken
by a hash of the key so that every run takes the same.  They only balance the tasks: every
row is placed by them, and results do not depend on where they lie.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_PART = 100
MOST = 1_000_000


def parts_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, key: Column, parts: int) -> list:
    """At most ``parts - 1`` ascending, distinct keys that cut the rows into about equal ranges."""
    want = min(parts * PER_PART, max(MOST, parts))
    share = min(1.0, want / max(1, df.count()))
    rows = (df.select(key.alias("k")).filter(F.col("k").isNotNull())
            .filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).collect())
    keys = sorted(r["k"] for r in rows)
    if not keys:
        return []
    cut = [keys[len(keys) * i // parts] for i in range(1, parts)]
    return sorted(set(cut))


def part_of(key: Column, cuts: list) -> Column:
    """Number of boundaries at or below the key; null keys come first."""
    if not cuts:
        return F.lit(0)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect_right(cuts, k) for k in keys.to_pylist()], pa.int32())

    return place(key)
