"""Readers, writers and previews.

``load(path)`` dispatches on the file suffix to a Spark reader and raises a
typed error for missing, empty or unsupported inputs.  CSV applies the
pandas NA-token list so "NA", "null", "N/A" ... become SQL nulls, then
re-infers the column types.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import c, is_numeric, nan_to_null, q

# fixed values: pandas' default NA tokens (read_csv na_values)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SUPPORTED = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}


class LoadError(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Header row, inferred types, NA tokens -> null (then types are re-inferred per column)."""
    raw = spark.read.option("header", header).option("inferSchema", False).csv(path)
    cleaned = raw.select(*[F.when(F.trim(c(x)).isin(NA_TOKENS), F.lit(None)).otherwise(c(x)).alias(x)
                           for x in raw.columns])
    return infer_types(cleaned)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each string column to bigint / double / timestamp when every non-null value parses.

    One aggregate decides all columns (count of values that fail each cast).
    """
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    aggs = []
    for i, x in enumerate(strs):
        for kind in ("bigint", "double", "timestamp"):
            expr = f"try_cast({q(x)} as {kind})" if kind != "timestamp" else f"try_to_timestamp({q(x)})"
            aggs.append(F.count_if(c(x).isNotNull() & F.expr(expr).isNull()).alias(f"{kind}_{i}"))
    row = df.agg(*aggs).first()
    out = []
    for f in df.schema.fields:
        if f.name not in strs:
            out.append(c(f.name))
            continue
        i = strs.index(f.name)
        if row[f"bigint_{i}"] == 0:
            out.append(F.expr(f"try_cast({q(f.name)} as bigint)").alias(f.name))
        elif row[f"double_{i}"] == 0:
            out.append(F.expr(f"try_cast({q(f.name)} as double)").alias(f.name))
        elif row[f"timestamp_{i}"] == 0:
            out.append(F.expr(f"try_to_timestamp({q(f.name)})").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of records (multi-line); ``multi_line=False`` for JSON-lines files."""
    return spark.read.option("multiLine", multi_line).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by suffix; typed errors for missing / empty / unsupported; NaN -> null."""
    local = path.startswith("/") or path.startswith("file:")
    p = path[len("file:"):] if path.startswith("file:") else path
    if local and not os.path.exists(p):
        raise LoadError(f"file not found: {path}")
    if local and os.path.isfile(p) and os.path.getsize(p) == 0:
        raise LoadError(f"file is empty: {path}")
    ext = os.path.splitext(p.rstrip("/"))[1].lower()
    if ext not in SUPPORTED:
        raise LoadError(f"unsupported file type '{ext}' (supported: {', '.join(sorted(SUPPORTED))})")
    fmt = SUPPORTED[ext]
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt == "json":
        df = read_json(spark, path, multi_line=os.path.isfile(p))   # a directory of part files is JSON lines
    else:
        df = read_parquet(spark, path)
    if not df.columns:
        raise LoadError(f"no columns in {path}")
    return nan_to_null(df)


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    """Inject an in-memory table (Arrow transfer)."""
    return nan_to_null(spark.createDataFrame(pdf))


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Csv (header, no index), json records, or parquet -- written by the executors."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise LoadError(f"unsupported export format {fmt}")


def head(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """Preview rows; with ``order_by`` the preview is deterministic (top-n per task, then merged)."""
    if order_by:
        return df.orderBy(*[c(x) for x in ([order_by] if isinstance(order_by, str) else order_by)]).limit(n)
    return df.limit(n)


def data_info(df: DataFrame) -> DataFrame:
    """Per column dtype, non-null count, nulls and pandas ``describe()`` of numeric columns."""
    from tabsmith.functions.stats import quantiles
    df = nan_to_null(df)
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, x in enumerate(df.columns):
        aggs.append(F.count(c(x)).alias(f"n{i}"))
        if x in num:
            v = c(x).cast("double")
            aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                     F.max(v).alias(f"max{i}")]
    wide = df.agg(*aggs)
    nul = F.lit(None).cast("double")
    structs = []
    for i, f in enumerate(df.schema.fields):
        isn = f.name in num
        g = (lambda k: F.col(f"{k}{i}")) if isn else (lambda k: nul)
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("count"),
                                (F.col("__rows") - F.col(f"n{i}")).alias("nulls"), g("mean").alias("mean"),
                                g("std").alias("std"), g("min").alias("min"), g("max").alias("max")))
    out = wide.select(F.inline(F.array(*structs)))
    if num:
        qs = quantiles(df, num, [0.25, 0.5, 0.75]).groupBy("column").agg(
            *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
              for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
        out = out.join(qs, "column", "left")
    return out
