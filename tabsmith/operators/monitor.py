"""Drift (D1, D2) and group fairness.

PSI: the baseline's 11 quantile edges per column (exact, outer edges moved
by 1e-9) are collected -- 11 numbers per column -- and inlined as literal
arrays; both tables are binned by one projection each (bin = number of
edges <= value, minus 1, last bin closed), counted by ``groupBy(column,
bin)`` and joined on (column, bin).  Fairness metrics are conditional
aggregates grouped by the protected attribute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import is_numeric
from tabsmith.functions.stats import long_values, quantile_dict

BINS = 10


def _finite_long(df, cols):
    lv = long_values(df, cols, "double")
    return lv.where(~F.isnan("value") & (F.abs("value") < float("inf")))


def psi(baseline: DataFrame, current: DataFrame, columns=None, bins: int = BINS, max_columns: int | None = None) -> DataFrame:
    """PSI per common numeric column: ``(column, psi, flag)``; null when a side has < 10 values.

    All common columns are reported, a column without finite baseline values with a null;
    ``max_columns`` keeps only the first so many.
    """
    if columns is None:
        bnum = [f.name for f in baseline.schema.fields if is_numeric(f.dataType)]
        cnum = {f.name for f in current.schema.fields if is_numeric(f.dataType)}
        columns = [x for x in bnum if x in cnum]
    columns = list(columns)[:max_columns] if max_columns else list(columns)
    spark = baseline.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, psi double, flag string")
    b_long = _finite_long(baseline, columns)
    probs = [i / bins for i in range(bins + 1)]
    qd = quantile_dict(baseline, columns, probs, finite=True)
    edges = {}
    for x in columns:
        e = list(qd[x])
        if e[0] is None:
            continue
        e[0] -= 1e-9
        e[-1] += 1e-9
        edges[x] = e
    if not edges:
        return spark.createDataFrame([(x, None, "") for x in columns], "column string, psi double, flag string")
    edge_map = F.create_map(*[v for x, e in edges.items() for v in (F.lit(x), F.array(*[F.lit(float(v)) for v in e]))])

    def binned(long):
        ed = F.element_at(edge_map, F.col("column"))
        n_le = F.size(F.filter(ed, lambda e: e <= F.col("value")))
        inside = (F.col("value") >= ed[0]) & (F.col("value") <= ed[bins])
        b = F.least(n_le - 1, F.lit(bins - 1))
        return (long.where(F.col("column").isin(list(edges)) & inside)
                .groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    cb = binned(b_long)
    cc = binned(_finite_long(current, columns))
    nb = b_long.groupBy("column").agg(F.count(F.lit(1)).alias("nb_all"))
    nc = _finite_long(current, columns).groupBy("column").agg(F.count(F.lit(1)).alias("nc_all"))
    grid = spark.createDataFrame([(x, i) for x in edges for i in range(bins)], "column string, bin int")  # cols x bins
    j = (grid.join(cb.withColumnRenamed("n", "a"), ["column", "bin"], "left")
         .join(cc.withColumnRenamed("n", "b"), ["column", "bin"], "left").fillna(0.0, ["a", "b"]))
    tot = j.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    j = j.join(tot, "column")
    pa = F.least(F.greatest(F.col("a") / F.greatest(F.col("ta"), F.lit(1.0)), F.lit(1e-6)), F.lit(1.0))
    pb = F.least(F.greatest(F.col("b") / F.greatest(F.col("tb"), F.lit(1.0)), F.lit(1e-6)), F.lit(1.0))
    s = j.groupBy("column").agg(F.sum((pb - pa) * F.log(pb / pa)).alias("psi"))
    s = spark.createDataFrame([(x,) for x in columns], "column string").join(s, "column", "left")
    out = (s.join(nb, "column", "left").join(nc, "column", "left")
           .select("column", F.when((F.coalesce(F.col("nb_all"), F.lit(0)) >= 10) & (F.coalesce(F.col("nc_all"), F.lit(0)) >= 10),
                                    F.col("psi")).alias("psi")))
    flag = F.when(F.col("psi") >= 0.25, "ALERT").when(F.col("psi") >= 0.1, "WARN").otherwise("")
    return out.withColumn("flag", flag)


def demographic_parity(df: DataFrame, group: str, label="label", prediction="prediction",
                       positive=None) -> DataFrame:
    """D3: P(prediction = positive | group); positive = the larger of the two labels."""
    pos = F.lit(positive) if positive is not None else _positive(df, label)
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(
        F.avg((F.col(prediction) == pos).cast("double")).alias("positive_rate"),
        F.count(F.lit(1)).alias("n"))


def _positive(df, label):
    r = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count_distinct(label).alias("k")).first()
    if r["k"] != 2:
        raise ValueError("fairness metrics need a binary target")
    return F.lit(r["hi"])


def disparate_impact(df: DataFrame, group: str, privileged: str, label="label", prediction="prediction") -> DataFrame:
    """Group rate / max(1e-6, privileged rate); ALERT below 0.8."""
    dp = demographic_parity(df, group, label, prediction).persist()
    row = dp.where(F.col("grp") == privileged).select("positive_rate").first()   # one number
    if row is None or row[0] is None:
        return dp.select("grp", "positive_rate", F.lit(None).cast("double").alias("disparate_impact"),
                         F.lit("").alias("flag")).limit(0)
    di = F.col("positive_rate") / F.greatest(F.lit(float(row[0])), F.lit(1e-6))
    return dp.select("grp", "positive_rate", di.alias("disparate_impact"),
                    F.when(di < 0.8, "ALERT").otherwise("").alias("flag"))


def equalized_odds(df: DataFrame, group: str, label="label", prediction="prediction") -> DataFrame:
    """TPR and FPR per group, denominators max(1, .)."""
    pos = _positive(df, label)
    y, p = F.col(label) == pos, F.col(prediction) == pos
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))
    return g.select("grp", (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))).alias("tpr"),
                    (F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn"))).alias("fpr"))
