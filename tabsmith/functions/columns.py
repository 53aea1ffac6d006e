"""Column kinds, NaN handling, coercion to numbers (F4-F12) and hash keys.

Everything here is a projection: one ``select`` that stays inside
whole-stage codegen.  Decisions that need the data (F9: does any value of
a string column parse as a number?) are made by one aggregate over all
such columns at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold spaces or dots)."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dt: T.DataType, include_bool: bool = False) -> bool:
    if isinstance(dt, T.BooleanType):
        return include_bool
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def kind(dt: T.DataType) -> str:
    """Numeric / Categorical / Datetime / Other (F5).  Bool counts as numeric."""
    if is_numeric(dt, include_bool=True):
        return "Numeric"
    if is_string(dt):
        return "Categorical"
    if is_datetime(dt):
        return "Datetime"
    return "Other"


def numeric_columns(df: DataFrame, include_bool: bool = False, exclude=()) -> list[str]:
    """numeric columns in schema order."""
    ex = set(exclude or ())
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType, include_bool) and f.name not in ex]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude or ())
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in ex]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """NaN is pandas' null: map NaN in float columns to SQL null (one projection)."""
    cols = set(columns or [f.name for f in df.schema.fields])
    out = []
    for f in df.schema.fields:
        if f.name in cols and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(c(f.name)), F.lit(None)).otherwise(c(f.name)).alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


def finite(col: Column) -> Column:
    """true for a finite, non-null number."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def inf_to_null(col: Column) -> Column:
    """F11 first half: +-inf (and NaN) become null."""
    return F.when(finite(col), col)


def drop_nonfinite(df: DataFrame, columns) -> DataFrame:
    """+-inf -> null, then drop rows with a null in the listed columns."""
    df = df.select(*[inf_to_null(c(x)).alias(x) if x in set(columns) else c(x) for x in df.columns])
    return df.dropna(how="any", subset=list(columns))


# ---------------------------------------------------------------- coercion

def epoch_seconds(col: Column) -> Column:
    """datetime -> epoch seconds as double (null stays null)."""
    return F.unix_micros(col.cast("timestamp")).cast("double") / F.lit(1e6)


def bool_to_int(col: Column) -> Column:
    """F7."""
    return col.cast("int")


def coerce_features(df: DataFrame, exclude=()) -> DataFrame:
    """make every column numeric, best effort, in one projection.

    * datetime -> epoch seconds, bool -> 0/1 (F6, F7)
    * string: if *any* value parses as a number -> ``try_cast`` (unparsable -> null);
      otherwise dense codes of the sorted distinct values (F9).  Category
      columns (F8) are strings in Spark and follow the same code path.
    The only data-dependent decisions are taken by one aggregate over all
    string columns; the code tables are distinct values (bounded by the
    column's cardinality) joined back by broadcast when small.
    """
    ex = set(exclude or ())
    strings = [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in ex]
    parse_any = {}
    if strings:
        # decided on the distinct values (one parse per distinct string, not per row)
        from tabsmith.functions.stats import value_counts
        hits = (value_counts(df, strings, "string")
                .groupBy("column").agg(F.max(F.expr("try_cast(value as double)").isNotNull().cast("int")).alias("p"))
                .collect())                                    # one row per string column
        got = {r["column"]: bool(r["p"]) for r in hits}
        parse_any = {s: got.get(s, False) for s in strings}
    out = df
    cols = []
    coded = []
    for f in df.schema.fields:
        n = f.name
        if n in ex:
            cols.append(c(n))
        elif is_datetime(f.dataType):
            cols.append(epoch_seconds(c(n)).alias(n))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(bool_to_int(c(n)).alias(n))
        elif is_string(f.dataType):
            if parse_any.get(n):
                cols.append(F.expr(f"try_cast({q(n)} as double)").alias(n))
            else:
                coded.append(n)
                cols.append(c(n))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(c(n).cast("double").alias(n))
        else:
            cols.append(c(n))
    out = out.select(*cols)
    for n in coded:
        out = factorize(out, n)
    return out


def factorize(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Sorted factorise: code = rank of the value among sorted distinct values, 0-based.

    The code table has one row per distinct value; the ranks come from a
    distributed prefix sum (no single-task window) and are joined back --
    broadcast by AQE when the table is small, shuffled otherwise.
    """
    from tabsmith.functions.stats import dense_codes
    out = out or column
    codes = dense_codes(df, column).select("__v", F.col("__code").cast("double").alias("__code"))
    joined = df.join(codes, c(column).eqNullSafe(F.col("__v")), "left")
    if out == column:
        cols = [F.col("__code").alias(out) if x == column else c(x) for x in df.columns]
    else:
        cols = [c(x) for x in df.columns] + [F.col("__code").alias(out)]
    return joined.select(*cols)


# ---------------------------------------------------------------- hash keys

def hash_bucket(cols, seed: int = 42, buckets: int = 10000) -> Column:
    """Deterministic bucket in [0, buckets) from md5 of the key columns.

    md5 is used (not Spark's murmur ``hash``) so DuckDB computes the same
    bucket; the value does not depend on partitioning or re-reads, unlike
    ``randomSplit``/``rand``.
    """
    key = F.concat_ws("|", F.lit(str(seed)), *[c(x).cast("string") for x in cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_bucket_sql(cols, seed: int = 42, buckets: int = 10000) -> str:
    """The DuckDB expression equal to :func:`hash_bucket`."""
    parts = ", ".join(f"cast({x} as varchar)" for x in cols)
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8))::bigint % {buckets})")


def hash_uniform(cols, seed: int = 42) -> Column:
    """Deterministic pseudo-uniform double in [0,1) from xxhash64 of the keys."""
    h = F.xxhash64(F.lit(seed), *[c(x) if isinstance(x, str) else x for x in cols])
    return (F.pmod(h, F.lit(1 << 52)).cast("double")) / F.lit(float(1 << 52))


def md5_uniform(cols, seed: int = 42) -> Column:
    """Deterministic uniform double in [0, 1) from the md5 of the keys; another engine computes the same."""
    key = F.concat_ws("|", F.lit(str(seed)), *[(c(x) if isinstance(x, str) else x).cast("string") for x in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def md5_uniform_sql(parts, seed: int = 42) -> str:
    """The DuckDB expression equal to :func:`md5_uniform`."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({x} AS VARCHAR)' for x in parts)})), 1, 13))::BIGINT / {float(1 << 52)})"


def sample_n(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """seeded down-sample to n rows, deterministic under any partitioning.

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each task keeps
    its own top n and only n rows per task reach the final merge.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c(x).cast("string") for x in key_cols]))
    return df.orderBy(key, *[c(x) for x in df.columns]).limit(n)
