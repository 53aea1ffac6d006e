"""Pairwise-complete correlations of many columns in one pass.

With the missing cells of X set to zero and a 0/1 matrix M of the present ones, M'M counts the rows that two columns
share, X'M and (X^2)'M are a column's sums over the rows of another, and X'X their products.  A task adds these four
p x p matrices up in NumPy and emits them in blocks of ``BLOCK`` columns; the blocks are summed on Spark and the driver
gets 4 p^2 numbers once.  Columns are shifted by their mean first, against cancellation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, fold

BLOCK = 128
#: Up to so many columns the pairs are plain aggregates of one JVM pass; more would not compile into one stage.
NARROW = 16


def _few(df: DataFrame, values: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """The same of a few columns by covariances and variances."""
    p = len(values)
    rows = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(values)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    both = {(i, j): F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull() for i, j in pairs}
    # not corr(): it divides by zero on constant columns
    aggs = [F.count_if(both[i, j]).alias(f"n{i}_{j}") for i, j in pairs]
    for i, j in pairs:
        if i < j:
            aggs += [F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}"), F.var_pop(F.when(both[i, j], F.col(f"v{i}"))).alias(f"a{i}_{j}"),
                     F.var_pop(F.when(both[i, j], F.col(f"v{j}"))).alias(f"b{i}_{j}")]
    got = rows.agg(*aggs).first()
    corr, n = np.full((p, p), np.nan), np.zeros((p, p))
    for i, j in pairs:
        n[i, j] = n[j, i] = got[f"n{i}_{j}"]
        if i < j and n[i, j] > 1 and (spread := got[f"a{i}_{j}"] * got[f"b{i}_{j}"]) > 0:
            corr[i, j] = corr[j, i] = min(1.0, max(-1.0, got[f"c{i}_{j}"] / spread ** 0.5))
    return corr, n


def correlation_matrix(df: DataFrame, values: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """(correlations, shared rows), p x p, of double expressions; NaN where two columns share fewer than two rows, are
    constant there, or share an infinite value.  Null and NaN are missing."""
    p = len(values)
    if not p:
        return np.zeros((0, 0)), np.zeros((0, 0))
    if p <= NARROW:
        return _few(df, values)
    present = [F.when(~F.isnan(v), v) for v in values]
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(present)])
    finite = [F.when(F.abs(F.col(f"v{i}")) < float("inf"), F.col(f"v{i}")) for i in range(p)]
    means = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    edges = list(range(0, p, BLOCK))

    def part(batches):
        out = np.zeros((5, p, p))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) if b.num_rows else np.zeros((0, p))
            there = ~np.isnan(x)
            endless = np.isinf(x)
            z = np.where(there & ~endless, x - shift, 0.0)
            m = there.astype(float)
            out[0] += m.T @ m
            out[1] += z.T @ m
            out[2] += (z * z).T @ m
            out[3] += z.T @ z
            if endless.any():
                out[4] += endless.astype(float).T @ m
        for i, r in enumerate(edges):
            for j, c in enumerate(edges):
                yield i * len(edges) + j, out[:, r: r + BLOCK, c: c + BLOCK].reshape(-1)

    got = collected(fold(rows, part))
    if not got:
        return np.full((p, p), np.nan), np.zeros((p, p))
    sums = np.zeros((5, p, p))
    for i, r in enumerate(edges):
        for j, c in enumerate(edges):
            cell = sums[:, r: r + BLOCK, c: c + BLOCK]
            cell[:] = got[i * len(edges) + j].reshape(cell.shape)
    n, s, q, xy, endless = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy - s * s.T / n
        var = np.maximum(q - s * s / n, 0)
        # what is left of a constant column is rounding
        var = np.where(var <= 1e-12 * np.maximum(q, 1e-300), 0, var)
        corr = cov / np.sqrt(var * var.T)
    corr[(n < 2) | (endless + endless.T > 0) | (var * var.T <= 0)] = np.nan
    return np.clip(corr, -1, 1), n
