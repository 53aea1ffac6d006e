"""Registry of named queries for the driver contract.

``register(name, sql)`` records a callable ``(spark, sf_dir) -> DataFrame``
and, when the operator is SQL-expressible, the DuckDB SQL that must return
the same rows.  Both sides round doubles with the same ``round(x, d)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_like_sql(col, d: int):
    """``round(x, d)`` computed as DuckDB does it: round-half-away(x * 10^d) / 10^d.

    Spark's own ``round`` rounds the shortest decimal text of the double, which
    differs from the binary product on exact ties (1.005 -> 1.01 vs 1.0).
    """
    m = float(10 ** d)
    return F.round(col * F.lit(m), 0) / F.lit(m)


def round_sig_like_sql(col, sig: int):
    """Round to ``sig`` significant digits, same IEEE steps as :func:`sig_sql` on DuckDB.

    For large magnitudes (variances ~1e9) where a fixed number of decimals
    exposes the last-bit differences between two engines' summation orders.
    """
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(col))))
    return F.when(col == 0, F.lit(0.0)).otherwise(round_like_sql(col / e, sig - 1) * e)


def sig_sql(expr: str, sig: int) -> str:
    e = f"pow(10.0, floor(log10(abs({expr}))))"
    return f"(CASE WHEN ({expr}) = 0 THEN 0.0 ELSE round(({expr}) / {e}, {sig - 1}) * {e} END)"


def rnd(df: DataFrame, digits: dict) -> DataFrame:
    """Round the listed double columns (same rule as the SQL side)."""
    return df.select(*[round_like_sql(F.col(x), digits[x]).alias(x) if x in digits else F.col(x)
                       for x in df.columns])


def load_all():
    """Import every query module so its ``register`` calls run."""
    from tabsmith.plans import (q_profile, q_prep, q_metrics, q_monitor, q_recommend,  # noqa: F401
                                q_models, q_learners, q_more, q_sources, q_explain)
    return QUERIES, ORACLE
