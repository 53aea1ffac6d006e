"""Packing by optimal length buckets.

The global histogram of lengths fixes the bucket boundaries: dynamic programming over the
histogram's lengths finds the boundaries with the least total padding when every document is
padded to its bucket's boundary.  Inside a bucket, documents follow a pseudorandom order and are
cut into batches of ``budget div boundary`` documents (one at least), so a batch never exceeds the
token budget unless a single document does.

Every distinct length is a point of the histogram, so the boundaries are optimal over the documents
and each is the length of one.  ``k`` distinct lengths need k * k / 2 words of text, so the driver
sees about 100 000 points for 5 billion words.

Cases: null and empty texts have length 0 and go to the first bucket; with fewer distinct lengths
than buckets every length is a boundary; an empty table gives an empty result; repeated rows are
packed each; other columns of the input are kept out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.mixing import word_count
from tabsmith.llm.order import running_start
from tabsmith.session import cut_lineage

BUCKETS = 12
BUDGET = 16384
SEED = 3


def boundaries(lengths, counts, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the greatest length) with the least total padding.

    ``cost(i, j)``: padding when points i..j share boundary j.  best[b][j] = min over i of
    best[b-1][i-1] + cost(i, j).  The best i never falls as j grows, so a layer is filled by halving: the
    middle of every open range of j looks only between its neighbours' choices, all ranges of a
    depth in one vectorised pass.
    """
    x = np.asarray(lengths, dtype=np.float64)
    c = np.asarray(counts, dtype=np.float64)
    n = len(x)
    if n == 0:
        return []
    rows = np.concatenate([[0.0], np.cumsum(c)])
    mass = np.concatenate([[0.0], np.cumsum(c * x)])
    best = x * rows[1:] - mass[1:]
    choice = []
    for _ in range(1, min(buckets, n)):
        # the last bucket holds points i..j; i = 0 keeps all in one bucket
        before = np.concatenate([[0.0], best[:-1]])
        nxt, arg = np.empty(n), np.zeros(n, dtype=np.int64)
        lo, hi, left, right = (np.array([v]) for v in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            width = np.minimum(right, j) - left + 1
            at = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(at - left, width)
            jj = np.repeat(j, width)
            cost = before[i] + x[jj] * (rows[jj + 1] - rows[i]) - (mass[jj + 1] - mass[i])
            nxt[j] = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(nxt[j], width))
            arg[j] = i[hit[np.searchsorted(hit, at)]]
            lo, hi, left, right = (np.concatenate(v) for v in ((lo, j + 1), (j - 1, hi), (left, arg[j]), (arg[j], right)))
            some = lo <= hi
            lo, hi, left, right = lo[some], hi[some], left[some], right[some]
        best = nxt
        choice.append(arg)
    out, j = [], n - 1
    for arg in reversed(choice):
        out.append(int(x[j]))
        if arg[j] == 0:
            return sorted(out)
        j = int(arg[j]) - 1
    out.append(int(x[j]))
    return sorted(out)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET,
         seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket (its boundary), batch (number in the bucket), place (in the batch), padding.

    ``length`` defaults to the number of words of ``text``.  The histogram is the only thing the
    driver sees.
    """
    n = F.coalesce((length if length is not None else word_count(F.col("text"))).cast("bigint"), F.lit(0))
    rows = cut_lineage(docs.select("doc_id", n.alias("n_tokens")))
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by("n_tokens")
    counts = hist["c"].to_numpy()
    tops = boundaries(hist["n_tokens"].to_numpy(), counts, buckets)
    total = int(counts.sum())
    bucket = F.lit(tops[-1] if tops else 0)
    for top in reversed(tops[:-1]):
        bucket = F.when(F.col("n_tokens") <= top, F.lit(top)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("bigint")).withColumn("_one", F.lit(1))
    rows = running_start(rows, "bucket", "doc_id", "_one", "_rank", total, seed)
    fit = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))), F.lit(1)).cast("bigint")
    return rows.withColumn("_fit", fit).select(
        "doc_id", "n_tokens", "bucket", F.expr("_rank div _fit").alias("batch"),
        (F.col("_rank") % F.col("_fit")).cast("bigint").alias("place"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"))
