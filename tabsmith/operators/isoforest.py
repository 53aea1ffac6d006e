"""Isolation forest outlier removal (O4; Liu, Ting & Zhou 2008).

* Sampling: a row joins tree t when its seeded hash for t falls below a
  rate giving ~3 x 256 rows per tree; each tree then keeps its 256 smallest
  hashes.  Only the sampled rows are shuffled (trees x ~768 rows).
* Growing: ``groupBy(tree).applyInPandas`` builds each tree with NumPy
  (random feature, uniform split in [min, max], height limit ceil(log2 256)).
* Scoring: the forest (trees x <= 511 nodes) is small; ``mapInPandas``
  walks all trees for a whole Arrow batch at once.
* Cut: rows whose score is in the top ``contamination`` share (exact
  quantile of the scores) are dropped.  Nulls count as 0 (as in the reference).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import c

SAMPLE = 256
#: Rows that go down the trees at once.
ROWS = 4096


def _c(n):
    """Average path length of an unsuccessful BST search (normaliser)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def fit_isolation_forest(df: DataFrame, cols, p: dict) -> dict:
    n_trees = int(p.get("n_estimators", 100))
    seed = int(p.get("random_state", 42))
    cont = float(p.get("contamination", 0.05))
    X = df.select(*[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, x in enumerate(cols)])
    n = X.count()
    if n == 0:
        return {"trees": [], "cols": cols, "threshold": None}
    psi = min(SAMPLE, n)
    rate = min(1.0, 3.0 * psi / n)
    # a row's key is its content and its number among equal rows: no dependence on partitions
    fs = [f"f{i}" for i in range(len(cols))]
    few = X.groupBy(*fs).agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.explode(F.expr("sequence(0L, (__n - 1) div 4096L)")))
    each = few.withColumn("__o", F.explode(F.expr("sequence(__c * 4096L, least(__n, (__c + 1) * 4096L) - 1)")))
    keyed = each.withColumn("__k", F.xxhash64(*fs, "__o"))
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("__k")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    trees_of = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                    lambda t: F.struct(t.alias("t"), h(t).alias("u"))), lambda s: s["u"] < rate)
    sampled = keyed.select(*[f"f{i}" for i in range(len(cols))], F.explode(trees_of).alias("__s")) \
        .select("*", F.col("__s.t").alias("tree"), F.col("__s.u").alias("u")).drop("__s")
    height = int(math.ceil(math.log2(max(2, psi))))
    m = len(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", *[f"f{i}" for i in range(m)]]).head(psi)
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        Xs = pdf[[f"f{i}" for i in range(m)]].to_numpy(float)
        feat, thr, left, right, size = [], [], [], [], []

        def build(idx, depth):
            node = len(feat)
            feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
            if depth >= height or len(idx) <= 1:
                return node
            j = int(rng.integers(0, m))
            lo, hi = Xs[idx, j].min(), Xs[idx, j].max()
            if lo == hi:
                return node
            s = float(rng.uniform(lo, hi))
            feat[node], thr[node] = j, s
            li = idx[Xs[idx, j] < s]
            ri = idx[Xs[idx, j] >= s]
            left[node] = build(li, depth + 1)
            right[node] = build(ri, depth + 1)
            return node
        build(np.arange(len(Xs)), 0)
        return pd.DataFrame({"tree": [t], "feat": [feat], "thr": [thr], "left": [left], "right": [right],
                             "size": [size], "n": [len(Xs)]})
    schema = ("tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>, "
              "n int")
    trees = [r.asDict() for r in sampled.groupBy("tree").applyInPandas(grow, schema).collect()]  # forest: small
    state = {"trees": trees, "cols": list(cols), "psi": psi, "contamination": cont}
    from tabsmith.functions.stats import quantile_dict
    scores = score_frame(df, state).select("score").persist()          # the quantile reads them several times
    state["threshold"] = quantile_dict(scores, ["score"], [1.0 - cont])["score"][0]
    scores.unpersist()
    return state


def walk(t: dict) -> tuple:
    """Feature, cut, children and path length of every node of a tree, and its height; a leaf's children are itself."""
    feat, left, right = np.array(t["feat"]), np.array(t["left"]), np.array(t["right"])
    depth, at, leaf = np.zeros(len(feat)), np.arange(len(feat)), feat < 0
    for i in np.flatnonzero(~leaf):                        # parents come before their children
        depth[[left[i], right[i]]] = depth[i] + 1
    child = np.stack([np.where(leaf, at, left), np.where(leaf, at, right)], 1).ravel()
    # the node's depth and a correction for the rows it holds
    return np.maximum(feat, 0), np.array(t["thr"], float), child, depth + np.array([_c(s) for s in t["size"]]), int(depth.max())


def lengths(x: np.ndarray, trees: list) -> np.ndarray:
    """Sum of the path lengths of every row over all trees."""
    flat, at, n = np.ascontiguousarray(x.T).ravel(), np.arange(len(x)), len(x)
    out = np.zeros(n)
    for feat, thr, child, length, height in trees:
        base, node = feat * n, np.zeros(n, np.int64)
        for _ in range(height):
            node = child.take(2 * node + (1 - (flat.take(base.take(node) + at) < thr.take(node))))
        out += length.take(node)
    return out


def score_frame(df: DataFrame, state: dict) -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(psi)) per row (higher = more anomalous), appended as ``score``."""
    cols, trees, psi = state["cols"], state["trees"], state["psi"]
    cn = _c(psi)
    names = list(df.columns)
    from pyspark.sql import types as T
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("score", T.DoubleType())])

    def run(it):
        tr = [walk(t) for t in trees]
        for pdf in it:
            X = np.column_stack([pd.to_numeric(pdf[x], errors="coerce").fillna(0.0).to_numpy(float) for x in cols]) \
                if len(pdf) else np.zeros((0, len(cols)))
            depth_sum = np.concatenate([lengths(X[s: s + ROWS], tr) for s in range(0, len(X), ROWS)]) if len(X) else np.zeros(0)
            eh = depth_sum / max(1, len(tr))
            pdf = pdf.copy()
            pdf["score"] = np.power(2.0, -eh / cn) if cn > 0 else 0.0
            yield pdf[names + ["score"]]
    return df.mapInPandas(run, out_schema)


def filter_isolation_forest(df: DataFrame, p: dict, state: dict) -> DataFrame:
    if not state.get("trees"):
        return df
    thr = state["threshold"]
    return score_frame(df, state).where(F.col("score") <= F.lit(float(thr))).drop("score")
