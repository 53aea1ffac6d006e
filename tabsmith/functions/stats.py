"""Distributed statistics building blocks.

* :func:`value_counts` -- long ``(column, value, cnt)`` table of distinct values,
  partially aggregated map-side, so a hot value costs one row, not a hot task.
* :func:`prefix_sum` -- exact running sum over a global order without a
  single-task window: range-partition, local window per partition, then a
  tiny per-partition offset table (bounded by partitions x groups).
* :func:`quantiles` -- exact interpolated quantiles (NumPy "linear" /
  DuckDB ``quantile_cont`` / Spark ``percentile``): approximate percentiles bracket
  every quantile, a second scan counts what lies below and inside the bracket, and
  the exact ranks are picked from the few values inside.  No data is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.functions.columns import c, q
from tabsmith.session import cut_lineage

# relative rank error of the bracketing percentiles is 1 / ACCURACY
ACCURACY = 10_000
# most rows inside a bracket that are brought together; above, the bracket is narrowed first
SLIVER = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a DataFrame whose scan yields fewer partitions than task slots.

    Only row-multiplying operators call this (unpivots, expansions).  On a
    large input (many files / row groups) it is a no-op; on a one-row-group
    file it turns a single-task stage into a parallel one.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df               # a shuffled input is spread already; asking it would run its stages
    if df.rdd.getNumPartitions() * 2 <= slots:
        return df.repartition(slots)
    return df


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_values(df: DataFrame, columns, value_type: str = "double",
                keep=()) -> DataFrame:
    """Unpivot ``columns`` to ``(column, value)`` rows with ``stack`` (nulls dropped)."""
    if not columns:
        raise ValueError("long_values needs at least one column")
    pairs = ", ".join(f"{_sql_str(x)}, cast({q(x)} as {value_type})" for x in columns)
    gen = F.expr(f"stack({len(columns)}, {pairs}) as (column, value)")
    out = spread(df.select(*[c(k) for k in keep], *[c(x) for x in columns if x not in keep]))
    out = out.select(*[c(k) for k in keep], gen)
    return out.where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns, value_type: str = "double") -> DataFrame:
    """``(column, value, cnt)`` over non-null values; partial aggregation per task."""
    return (long_values(df, columns, value_type)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sum(df: DataFrame, group, order: str, weight: str | None = None,
               out: str = "cum_before", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over rows strictly before in ``order``, per ``group``.

    Rows tied on ``(group, order)`` get an arbitrary but contiguous order.
    With ``weight=None`` each row weighs 1, so ``out`` is a 0-based row number.
    Work per task is one range partition; the only cross-partition state is
    one offset per (partition, group), broadcast back.
    """
    group = list(group or [])
    spark = df.sparkSession
    p = partitions or _partitions(spark)
    w = F.col(weight) if weight else F.lit(1)
    ranged = (df.withColumn("__w", w)
              .repartitionByRange(p, *[F.col(g) for g in group], F.col(order))
              .withColumn("__pid", F.spark_partition_id()))
    # the partition id must survive recomputation: checkpoint reliably
    ranged = cut_lineage(ranged)
    local_w = Window.partitionBy("__pid", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum("__w").over(local_w), F.lit(0)))
    tots = ranged.groupBy("__pid", *group).agg(F.sum("__w").alias("__tot"))
    off_w = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group else Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tots.select("__pid", *group, F.coalesce(F.sum("__tot").over(off_w), F.lit(0)).alias("__off"))
    # offs has at most partitions x groups rows
    res = local.join(F.broadcast(offs), ["__pid", *group], "inner")
    return res.withColumn(out, F.col("__off") + F.col("__local")).drop("__pid", "__off", "__local", "__w")


def _inside(v, lo, hi):
    return (v >= F.lit(lo)) & (v <= F.lit(hi))


def quantile_dict(df: DataFrame, columns, probs, approx: bool = False, finite: bool = False,
                  accuracy: int = ACCURACY, sliver: int = SLIVER) -> dict:
    """Exact interpolated quantiles ``{column: [value per prob]}``; None for columns without values.

    ``finite`` leaves NaN and infinities out (else NaN is the greatest value).  ``approx`` stops after the
    bracketing scan.  Scans: approximate percentiles around every wanted rank; counts below and
    inside each bracket; the distinct values inside, with counts.  A bracket with more than ``sliver``
    rows is narrowed by further percentiles of its own rows before they are brought together.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    res = {x: [None] * len(probs) for x in columns}
    if not columns or not probs:
        return res
    vals = []
    for i, x in enumerate(columns):
        v = c(x).cast("double")
        vals.append((F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) if finite else v).alias(f"v{i}"))
    base = df.select(*vals)
    v = [F.col(f"v{i}") for i in range(len(columns))]
    eps = 2.0 / accuracy
    around = probs if approx else [min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)]
    first = base.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(v)],
                     *[F.percentile_approx(x, around, accuracy).alias(f"q{i}") for i, x in enumerate(v)]).first()
    if approx:
        return {x: list(first[f"q{i}"] or res[x]) for i, x in enumerate(columns)}
    want = {}                   # (column number, prob number) -> [rank, next rank, fraction, low, high]
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            pos = p * (n - 1)
            k = int(math.floor(pos))
            lo, hi = first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]
            want[(i, j)] = [k, min(k + 1, n - 1), pos - k, lo, hi]
    done, stuck = {}, set()
    while todo := [x for x in want if x not in done]:
        aggs = []
        for i, j in todo:
            lo, hi = want[(i, j)][3:]
            aggs += [F.count_if(v[i] < F.lit(lo)).alias(f"b{i}_{j}"), F.count_if(_inside(v[i], lo, hi)).alias(f"c{i}_{j}")]
        counts = base.agg(*aggs).first()
        narrow = []
        for i, j in todo:
            k, k1, _, lo, hi = want[(i, j)]
            below, within = counts[f"b{i}_{j}"], counts[f"c{i}_{j}"]
            if k < below or k1 >= below + within:       # the sketch missed: take everything on that side
                want[(i, j)][3:] = [lo if k >= below else float("-inf"), hi if k1 < below + within else float("nan")]
            elif lo == hi or within <= sliver or (i, j) in stuck:
                done[(i, j)] = below
            else:
                narrow.append((i, j, below, within))
        if narrow:
            aggs = []
            for i, j, below, within in narrow:
                k, k1, _, lo, hi = want[(i, j)]
                ps = [max(0.0, (k - below) / within - eps), min(1.0, (k1 + 1 - below) / within + eps)]
                aggs.append(F.percentile_approx(F.when(_inside(v[i], lo, hi), v[i]), ps, accuracy).alias(f"q{i}_{j}"))
            row = base.agg(*aggs).first()
            for i, j, _, _ in narrow:
                if list(row[f"q{i}_{j}"]) == want[(i, j)][3:]:
                    stuck.add((i, j))                     # a few heavy values: distinct values are few
                want[(i, j)][3:] = list(row[f"q{i}_{j}"])
    wide = sorted(x for x in want if want[x][3] != want[x][4])
    values = {x: [] for x in wide}
    if wide:
        # one array per row of the brackets it falls into, nearly always empty
        hits = [F.when(_inside(v[i], *want[(i, j)][3:]), F.struct(F.lit(n).alias("b"), v[i].alias("v")))
                for n, (i, j) in enumerate(wide)]
        rows = base.select(F.inline(F.filter(F.array(*hits), lambda s: s.isNotNull())))
        for r in rows.groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            values[wide[r["b"]]].append((math.isnan(r["v"]), r["v"], r["n"]))
    for (i, j), (k, k1, frac, lo, hi) in want.items():
        a = b = lo
        if (i, j) in values:
            at = done[(i, j)]
            for _, x, n in sorted(values[(i, j)]):
                if at <= k < at + n:
                    a = x
                if at <= k1 < at + n:
                    b = x
                at += n
        res[columns[i]][j] = a + frac * (b - a) if frac else a
    return res


def quantiles(df: DataFrame, columns, probs, approx: bool = False) -> DataFrame:
    """:func:`quantile_dict` as a DataFrame ``(column, prob, value)``."""
    got = quantile_dict(df, columns, probs, approx=approx)
    rows = [(x, float(p), y) for x in columns for p, y in zip(probs, got[x]) if y is not None]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def dense_codes(df: DataFrame, column: str, code: str = "__code") -> DataFrame:
    """Sorted distinct values of ``column`` with 0-based codes, computed distributed."""
    d = df.select(c(column).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    return prefix_sum(d, [], "__v", None, out=code)


def skew_bias_corrected(col) -> "F.Column":
    """pandas ``Series.skew``: adjusted Fisher-Pearson G1 from Spark's population g1."""
    n = F.count(col).cast("double")
    return F.when(n >= 3, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_bias_corrected(col) -> "F.Column":
    """pandas ``Series.kurt``: bias-corrected excess kurtosis G2 from Spark's g2."""
    n = F.count(col).cast("double")
    g2 = F.kurtosis(col)
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
