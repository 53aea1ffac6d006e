"""Extremely randomised trees, all grown together level by level.

A node tries random features with one random cut each, uniform between the node's least and greatest value, and takes the
best; every tree sees all rows.  All trees of the forest grow one level in two passes over the
rows, whatever their number: the first gives the value ranges of every open node, the second the label sums left of
every candidate cut.  A pass sends each row down all trees at once (NumPy, the forest so far is broadcast), adds
into arrays by open node, and the arrays are folded on Spark (``functions.partials``).  Nothing is sorted or
binned and no row is copied per tree.  Rows of equal features take the same way in every tree: whatever the table's size, they
are one row with their label sums.

Randomness is a hash of (seed, tree, path, feature), so a forest depends on rows, not on partitions or retries.

Bounds: a node holds at least n / ``LEAVES`` rows (one at least), so a tree has at most about ``LEAVES`` leaves whatever
the table's size, and the driver and every task can hold the forest; the depth ends at ``DEPTH`` levels as in Spark ML.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, fold, matrix
from tabsmith.functions.storage import Stored

LEAVES = 1024
DEPTH = 30
#: Open nodes whose arrays travel as one row.
NODES = 2048
#: Rows that go down the trees at once, and in a fit.
ROWS = 512
FIT_ROWS = 4096
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(key: np.ndarray) -> np.ndarray:
    return (_mix(key) >> U(11)).astype(float) / float(1 << 53)


class Forest:
    """Nodes of all trees in one row of arrays: children follow each other, leaves point to themselves."""

    def __init__(self, trees: int, seed: int):
        self.trees = trees
        self.feature = np.full(trees, -1, np.int32)
        self.cut = np.zeros(trees)
        self.left = np.arange(trees, dtype=np.int32)
        with np.errstate(over="ignore"):
            self.key = _mix(np.arange(trees, dtype=U) + _mix(np.array([seed], U)))
        self.value = None                      # per node: class shares or the mean
        self.gain = None                       # per feature

    def place(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row in every tree, (rows, trees)."""
        node = np.broadcast_to(np.arange(self.trees, dtype=np.int32), (len(x), self.trees)).copy()
        at = np.arange(len(x))[:, None]
        for _ in range(depth):
            f = self.feature[node]
            node = self.left[node] + ((x[at, np.maximum(f, 0)] > self.cut[node]) & (f >= 0))
        return node

    def opened(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of the rows that are ``depth`` levels down, tree by tree; a row that ends in a leaf above goes no further."""
        rows, nodes = [], []
        at = np.arange(len(x))
        for tree in range(self.trees):
            row, node = at, np.full(len(x), tree, np.int32)
            for _ in range(depth):
                f = self.feature[node]
                on = f >= 0
                if not on.all():
                    row, node, f = row[on], node[on], f[on]
                node = self.left[node] + (x[row, f] > self.cut[node])
            rows.append(row)
            nodes.append(node)
        return np.concatenate(rows), np.concatenate(nodes).astype(np.int64)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
        """Give ``nodes`` two children each, in order."""
        first = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes] = feature, cut, first
        n = 2 * len(nodes)
        with np.errstate(over="ignore"):
            sides = _mix(np.repeat(self.key[nodes], 2) * U(2) + np.tile(np.array([0, 1], U), len(nodes)) + U(0x9E3779B97F4A7C15))
        self.key = np.concatenate([self.key, sides])
        self.feature = np.concatenate([self.feature, np.full(n, -1, np.int32)])
        self.cut = np.concatenate([self.cut, np.zeros(n)])
        self.left = np.concatenate([self.left, np.arange(len(self.left), len(self.left) + n, dtype=np.int32)])


def candidates(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, cuts) of every node, (nodes, tries): features in the order of a hash, constant ones last (feature -1)."""
    n, width = lo.shape
    with np.errstate(over="ignore"):
        base = key[:, None] + U(0x632BE59BD9B4E019) * (np.arange(width, dtype=U) + U(1))[None]
        order = np.where(lo < hi, _uniform(base), 2.0)
        picked = np.argsort(order, axis=1, kind="stable")[:, :tries]
        at = np.arange(n)[:, None]
        low, high = lo[at, picked], hi[at, picked]
        cut = low + _uniform(base[at, picked] + U(0xD1B54A32D192ED03)) * (high - low)
    # rounding must not carry a cut to the greatest value, which would leave the right side empty
    cut = np.where(cut < high, cut, low)
    return np.where(low < high, picked, -1).astype(np.int32), cut


def best_cuts(total: np.ndarray, left: np.ndarray, feature: np.ndarray, classes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, gain) per node, candidate -1 where none may split; ``total`` (nodes, s), ``left`` (nodes, tries, s).

    s: the class counts, or n, sum and sum of squares.  Of equal gains (to nine digits) the first candidate counts.
    """
    right = total[:, None] - left
    with np.errstate(invalid="ignore", divide="ignore"):
        if classes:
            n_l, n_r = left.sum(2), right.sum(2)
            gain = (left ** 2).sum(2) / n_l + (right ** 2).sum(2) / n_r - ((total ** 2).sum(1) / total.sum(1))[:, None]
            scale = total.sum(1)
        else:
            n_l, n_r = left[..., 0], right[..., 0]
            gain = left[..., 1] ** 2 / n_l + right[..., 1] ** 2 / n_r - (total[:, 1] ** 2 / total[:, 0])[:, None]
            scale = np.maximum(total[:, 2], 1e-300)
        ok = (feature >= 0) & (n_l >= least) & (n_r >= least)
        gain = np.where(ok, np.round(gain / scale[:, None], 9), -np.inf)
    best = gain.argmax(1)
    top = gain[np.arange(len(gain)), best]
    return np.where(np.isfinite(top), best, -1), top


def pure(total: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return total.max(1) >= total.sum(1)
    n = np.maximum(total[:, 0], 1)
    return total[:, 2] / n - (total[:, 1] / n) ** 2 <= 1e-12 * np.maximum(total[:, 2] / n, 1e-300)


def label_stats(y: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return np.eye(classes)[y.astype(int)]
    return np.stack([np.ones(len(y)), y, y * y], 1)


def _distinct(rows, classes: int):
    """(x, s) of the distinct feature vectors of (x, y): s lists (class, rows), or has one entry n, sum and sum of squares."""
    if classes:
        return rows.groupBy("x", "y").agg(F.count("*").alias("n")).groupBy("x").agg(F.collect_list(F.struct("y", "n")).alias("s"))
    return rows.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("q")).select(
        "x", F.array("n", "y", "q").alias("s"))


def _label_sums(column: pa.Array, classes: int) -> np.ndarray:
    """Label sums of distinct rows: the class counts, or n, sum and sum of squares."""
    if not classes:
        return matrix(column)
    each, row = column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), classes))
    np.add.at(out, (row, each.field("y").to_numpy(zero_copy_only=False).astype(int)), each.field("n").to_numpy(zero_copy_only=False))
    return out


def _blocks(array: np.ndarray, used: np.ndarray):
    """(block, rows of the block as one array) for the blocks with a used node."""
    for b in np.unique(np.flatnonzero(used) // NODES):
        yield int(b), array[b * NODES: (b + 1) * NODES].reshape(-1)


class ExtraTrees(Estimator):
    """``max_features``: all for regression, the square root for classification."""

    def __init__(self, featuresCol="features", labelCol="label", task="classification", n_estimators=500, max_depth=None,
                 min_samples_leaf=None, seed=42):
        super().__init__()
        self.fc, self.lc, self.task, self.trees = featuresCol, labelCol, task, n_estimators
        self.max_depth, self.min_leaf, self.seed = max_depth or DEPTH, min_samples_leaf, seed

    def _fit(self, df):
        rows = df.select(vector_to_array(F.col(self.fc)).alias("x"), F.col(self.lc).cast("double").alias("y"))
        rows = rows.filter("y is not null and not isnan(y)")
        head = rows.agg(F.count("*").alias("n"), F.max("y").alias("k"), F.max(F.size("x")).alias("p")).first()
        n, width = head["n"], head["p"] or 0
        classes = int(head["k"]) + 1 if self.task == "classification" and n else 0
        if not n:
            raise ValueError("no rows to fit")
        rows = _distinct(rows, classes).persist()
        # every row goes down every tree: a table in fewer partitions than task slots is dealt out
        slots = df.sparkSession.sparkContext.defaultParallelism
        if rows.count() > 1 and rows.rdd.getNumPartitions() < slots:
            few, rows = rows, rows.repartition(slots).persist()
            rows.count()                       # computed before what it comes from is let go
            few.unpersist()
        try:
            return self.grown(rows, n, width, classes, lambda b: (matrix(b.column(0)), _label_sums(b.column(1), classes)))
        finally:
            rows.unpersist()

    def grown(self, rows, n: int, width: int, classes: int, read) -> _ForestModel:
        """The forest of ``rows``, which stand for ``n`` rows of the table; ``read`` gives (x, label sums) of a batch."""
        spark = rows.sparkSession
        tries = max(1, math.isqrt(width)) if classes else width
        least = self.min_leaf or max(1, -(-n // LEAVES))
        forest = Forest(self.trees, self.seed)
        forest.gain = np.zeros(width)
        stats = classes or 3
        totals = None
        start, depth = 0, 0
        while True:
            open_nodes = np.arange(start, len(forest.feature))
            size = len(open_nodes)
            sent = spark.sparkContext.broadcast(forest)

            def ranges(batches, start=start, size=size, depth=depth, sent=sent):
                lo, hi = np.full((width, size), np.inf), np.full((width, size), np.inf)   # hi as its negative: one minimum
                for x, _, row, node in _down(batches, read, sent.value, depth):
                    slot = node - start
                    for f in range(width):
                        v = x[row, f]
                        np.minimum.at(lo[f], slot, v)
                        np.minimum.at(hi[f], slot, -v)
                yield from _blocks(np.concatenate([lo, hi]).T, np.isfinite(lo[0]))

            got = collected(fold(rows, ranges, np.minimum))
            both = _joined(got, size, 2 * width, np.inf)
            feature, cut = candidates(forest.key[open_nodes], both[:, :width], -both[:, width:], tries)
            if totals is not None:
                # nodes that end here need no cuts
                done = pure(totals, classes) | ((totals if classes else totals[:, :1]).sum(1) < 2 * least)
                feature[done] = -1
            cuts = spark.sparkContext.broadcast((feature, cut))

            def sums(batches, start=start, size=size, depth=depth, sent=sent, cuts=cuts):
                feature, cut = cuts.value
                out = np.zeros(((tries + 1) * stats, size))
                for x, label, row, node in _down(batches, read, sent.value, depth):
                    slot = node - start
                    for s in range(stats):
                        out[s] += np.bincount(slot, label[row, s], size)
                    for k in range(tries):
                        f = feature[slot, k]
                        left = (f >= 0) & (x[row, np.maximum(f, 0)] <= cut[slot, k])
                        at, those = slot[left], row[left]
                        for s in range(stats):
                            out[(k + 1) * stats + s] += np.bincount(at, label[those, s], size)
                yield from _blocks(out.T, out[:1 if not classes else stats].sum(0) > 0)

            got = _joined(collected(fold(rows, sums)), size, (tries + 1) * stats, 0.0)
            total = got[:, :stats]
            left = got[:, stats:].reshape(size, tries, stats)
            if forest.value is None:
                forest.value = _values(total, classes)
            pick, gain = best_cuts(total, left, feature, classes, least)
            pick = np.where(pure(total, classes), -1, pick)
            sent.destroy()
            cuts.destroy()
            grow = np.flatnonzero(pick >= 0)
            if not len(grow) or depth >= self.max_depth:
                break
            k = pick[grow]
            np.add.at(forest.gain, feature[grow, k], np.maximum(gain[grow], 0) * (total[grow].sum(1) if classes else total[grow, 2]))
            start = len(forest.feature)
            forest.split(open_nodes[grow], feature[grow, k], cut[grow, k])
            child = np.stack([left[grow, k], total[grow] - left[grow, k]], 1).reshape(-1, stats)
            totals = child
            forest.value = np.concatenate([forest.value, _values(child, classes)])
            depth += 1
        whole = forest.gain.sum()
        return _ForestModel(forest.trees, depth, classes, forest.feature, forest.cut, forest.left, forest.value,
                            forest.gain / whole if whole > 0 else forest.gain, self.fc)


def _values(total: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return total / np.maximum(total.sum(1, keepdims=True), 1)
    return (total[:, 1] / np.maximum(total[:, 0], 1))[:, None]


def _joined(blocks: dict, size: int, width: int, empty: float) -> np.ndarray:
    out = np.full((size, width), empty)
    for b, x in blocks.items():
        out[b * NODES: (b + 1) * NODES] = x.reshape(-1, width)
    return out


def _down(batches, read, forest: Forest, depth: int):
    """(x, label sums, row, node) for small runs of rows, with a (row, node) for every tree where a row is in an open node."""
    for b in batches:
        x, label = read(b)
        for s in range(0, len(x), FIT_ROWS):
            part = x[s: s + FIT_ROWS]
            yield part, label[s: s + FIT_ROWS], *forest.opened(part, depth)


class _ForestModel(Model, Stored):
    """Mean of the trees' leaves; ``probability`` for classes."""

    _fields = ("trees", "depth", "classes", "feature", "cut", "left", "value", "importance", "fc")

    def __init__(self, trees, depth, classes, feature, cut, left, value, importance, fc):
        super().__init__()
        self.trees, self.depth, self.classes, self.fc = trees, depth, classes, fc
        self.feature, self.cut, self.left, self.value, self.importance = feature, cut, left, value, np.asarray(importance)

    @property
    def featureImportances(self):
        return Vectors.dense(self.importance)

    def forest(self) -> Forest:
        out = Forest(self.trees, 0)
        out.feature, out.cut, out.left, out.value = self.feature, self.cut, self.left, self.value
        return out

    def _transform(self, df):
        # at most trees * 2 * LEAVES nodes
        sent = df.sparkSession.sparkContext.broadcast(self.forest())
        depth = self.depth

        @F.arrow_udf("array<double>")
        def mean(x: pa.Array) -> pa.Array:
            forest, rows = sent.value, matrix(x)
            out = [forest.value[forest.place(rows[s: s + ROWS], depth)].mean(1) for s in range(0, len(rows), ROWS)]
            flat = np.concatenate(out) if out else np.zeros((0, forest.value.shape[1]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * forest.value.shape[1]), pa.array(flat.reshape(-1)))

        out = df.withColumn("_mean", mean(vector_to_array(F.col(self.fc))))
        if not self.classes:
            return out.withColumn("prediction", F.col("_mean")[0]).drop("_mean")
        out = out.withColumn("prediction", (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("_mean")).drop("_mean")
