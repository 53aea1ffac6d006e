"""Model comparison.

Metric tables are long ``(model, metric, value)``; every operator here is a
grouped aggregate or a window over one row per model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.functions.partials import fold

# fixed values: primary / secondary metric per task and direction (True = higher is better)
PRIMARY = {
    "classification": ("f1_score", True, "roc_auc", True),
    "regression": ("rmse", False, "mae", False),
    "clustering": ("silhouette", True, "davies_bouldin", False),
    "dimensionality_reduction": ("explained_variance_ratio", True, "reconstruction_error", False),
}
LOWER_IS_BETTER = {"rmse", "mae", "mape", "msle", "log_loss", "davies_bouldin", "reconstruction_error"}


def to_long(wide: DataFrame, metrics, key=("model",)) -> DataFrame:
    """Wide metric columns -> ``(key..., metric, value)``."""
    k = list(key)
    structs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return wide.select(*k, F.inline(F.array(*structs)))


def comparison_table(long: DataFrame, metrics, key=("model",)) -> DataFrame:
    """Q1: model x metric table (pivot with an explicit metric list: no extra distinct job)."""
    return long.groupBy(*key).pivot("metric", list(metrics)).agg(F.first("value"))


def primary_metric(task: str):
    """Q2."""
    return PRIMARY.get(task, PRIMARY["classification"])


def best_model(long: DataFrame, metric: str, higher_is_better: bool | None = None, key="model") -> DataFrame:
    """Best row for ``metric``, direction-aware; ties -> smaller key."""
    hib = (metric not in LOWER_IS_BETTER) if higher_is_better is None else higher_is_better
    v = F.col("value")
    w = Window.partitionBy("metric").orderBy(v.desc_nulls_last() if hib else v.asc_nulls_last(), F.col(key))
    return (long.where((F.col("metric") == metric) & F.col("value").isNotNull())
            .withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r"))


def worst_model(long: DataFrame, metric: str, higher_is_better: bool | None = None, key="model") -> DataFrame:
    hib = (metric not in LOWER_IS_BETTER) if higher_is_better is None else higher_is_better
    return best_model(long, metric, not hib, key)


def paired_ttest(losses: DataFrame, best: str, row_id="row_id", model="model", loss="loss") -> DataFrame:
    """Q4 + Q5: paired t-test of every model's per-sample loss against ``best``.

    Rows are paired by ``row_id`` (J3, an equi-join).  t = mean(d) / (sd(d)/sqrt(n)),
    two-sided p of Student's t with n - 1 degrees of freedom, Bonferroni p * m capped at 1 with a '*' flag below .05.
    n < 5 or sd = 0 -> no row.
    """
    a = losses.where(F.col(model) != best).select(F.col(model).alias("model"), row_id, F.col(loss).alias("la"))
    b = losses.where(F.col(model) == best).select(row_id, F.col(loss).alias("lb"))
    d = a.join(b, row_id).withColumn("d", F.col("la") - F.col("lb"))
    st = d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"),
                                F.stddev_samp("d").alias("sd"))
    st = st.where((F.col("n") >= 5) & (F.col("sd") > 0))
    t = F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n")))
    out = st.select("model", F.lit(best).alias("baseline"), "n", "mean_diff", t.alias("t"))
    out = out.withColumn("p", student_p(F.col("t"), F.col("n") - 1))
    m = F.count(F.lit(1)).over(Window.partitionBy("baseline"))   # one row per model
    return out.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * m)) \
        .withColumn("significant", F.col("p_bonferroni") < 0.05)


def student_p(t, df, steps: int = 600):
    """Two-sided tail probability of Student's t (two degrees of freedom or more) as a Column expression.

    The density over x = s / (1 - s) is smooth on 0 <= s < 1 whatever ``df`` is; the
    tail and the whole are integrated by Simpson's rule, and their ratio needs no
    normalising constant.
    """
    def integral(lo):
        h = (F.lit(1.0) - lo) / F.lit(steps)

        def add(acc, i):
            s = lo + h * i
            x = s / (F.lit(1.0) - s)
            g = F.exp(-(df + 1) / F.lit(2.0) * F.log1p(x * x / df)) / ((F.lit(1.0) - s) * (F.lit(1.0) - s))
            w = F.when(i == 0, 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            # at s = 1 the density is zero
            return acc + F.when(i < steps, w * g).otherwise(0.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), add) * h
    a = F.abs(t)
    return F.least(F.lit(1.0), integral(a / (F.lit(1.0) + a)) / integral(F.lit(0.0)))


#: Cumulative probabilities of Poisson(1) at 0, 1, ..., 7 (all but 1e-5 of the mass).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
#: Uniform draws are integers below this prime.
PRIME = (1 << 31) - 1
#: Groups whose sums a task holds at once.
GROUPS = 200


def bootstrap_ci(values: DataFrame, value="value", group=(), n_boot: int = 500, alpha: float = 0.05,
                 seed: int = 42, row_id="row_id") -> DataFrame:
    """Q6: percentile bootstrap CI of a mean with Poisson(1) resampling weights.

    A row's weight in replicate b comes from the draw (h1 + b * h2) mod ``PRIME``, h1 and h2 being halves of the md5
    of seed and row id: independent between rows, pairwise independent between replicates.  Every task adds
    its rows into two arrays of ``n_boot`` sums per group; the arrays are folded on Spark.  No row is repeated.
    """
    g = list(group)
    v = F.col(value).cast("double")
    d = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    half = [F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") % PRIME for at in (1, 9)]
    gid = F.xxhash64(*[F.col(x) for x in g]) if g else F.lit(0).cast("bigint")
    rows = d.select(gid.alias("gid"), v.alias("v"), half[0].alias("h1"), half[1].alias("h2")).where("h1 is not null")
    # every row is worked on n_boot times: few large partitions are dealt out, 32 bytes a row
    rows = rows.repartition(max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), d.sparkSession.sparkContext.defaultParallelism))
    limits = np.array([int(p * PRIME) for p in POISSON], np.int64)

    def sums(batches):
        acc = {}
        b = np.arange(n_boot, dtype=np.int64)
        for batch in batches:
            ids, x, h1, h2 = (batch.column(i).to_numpy() for i in range(4))
            for s in range(0, len(x), 4096):
                part = slice(s, s + 4096)
                draw = (h1[part, None] + b[None] * h2[part, None]) % PRIME
                w = sum((draw > t).astype(np.uint8) for t in limits).astype(float)
                for one in np.unique(ids[part]):
                    m = ids[part] == one
                    acc.setdefault(int(one), np.zeros(2 * n_boot))
                    acc[int(one)] += np.concatenate([x[part][m] @ w[m], w[m].sum(0)])
            if len(acc) > GROUPS:
                yield from acc.items()
                acc = {}
        yield from acc.items()

    def ends(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                total, weight = np.frombuffer(data, np.float64).reshape(2, -1)
                means = total[weight > 0] / weight[weight > 0]
                out.append(np.quantile(means, [alpha / 2, 1 - alpha / 2]) if len(means) else [np.nan, np.nan])
            lo_hi = np.array(out).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo_hi[:, 0]), pa.array(lo_hi[:, 1])], names=["gid", "lo", "hi"])

    ci = fold(rows, sums).mapInArrow(ends, "gid bigint, lo double, hi double")
    base = d.groupBy(*g).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("gid", gid)
    return base.join(ci, "gid").select(*g, "mean", "n", "lo", "hi").where(F.col("n") >= 5)


def overfit_gap(long_by_split: DataFrame, key=("model",)) -> DataFrame:
    """Q7: train metric - test metric per (model, metric)."""
    k = list(key)
    return long_by_split.groupBy(*k, "metric").agg(
        F.first(F.when(F.col("split") == "train", F.col("value")), ignorenulls=True).alias("train"),
        F.first(F.when(F.col("split") == "test", F.col("value")), ignorenulls=True).alias("test")) \
        .withColumn("gap", F.col("train") - F.col("test"))


def normalise_metrics(long: DataFrame) -> DataFrame:
    """Min-max normalise each metric across models (zero range -> divide by 1)."""
    w = Window.partitionBy("metric")
    rng = F.max("value").over(w) - F.min("value").over(w)
    return long.withColumn("norm", (F.col("value") - F.min("value").over(w))
                           / F.when(rng == 0, F.lit(1.0)).otherwise(rng))
