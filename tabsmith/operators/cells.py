"""Trees over cells: rows whose features fall into the same bins are one row with their counts and sums.

Spark ML's trees bin every feature at up to ``BINS`` - 1 thresholds from a sample and never tell rows of equal bins apart, so
a tree needs the cells only: one pass bins the rows, and Spark adds them up by their bins.  A table without equal cells
keeps a cell per row.

A decision tree grows in two steps.  Levels of large nodes are grown together, from label sums by (node, feature, bin) that are
folded on Spark (``functions.partials``).  A node of at most ``LOCAL`` cells goes to one task with its cells, where
its whole subtree grows; the driver holds the finished nodes, as it does with Spark ML.

Splits are Spark ML's: the greatest decrease of variance or Gini impurity, of equal ones the first feature and the lowest cut;
at the end two leaves of one answer become one.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, dealt_out, fold, matrix
from tabsmith.functions.storage import Stored
from tabsmith.operators.forest import Forest, _ForestModel
from tabsmith.operators.neighbours import finite

BINS = 32
#: Rows of the sample that places the thresholds, as in Spark ML.
SAMPLE = 10_000
#: Tables of at most so many rows are fitted by Spark ML row by row.
SMALL = 100_000
#: Classes that Spark ML accepts of a label without metadata.
CLASSES = 100
#: Cells of a node whose subtree grows in one task, and numbers of the sums that are held at once there.
LOCAL = 5_000
HELD = 1 << 17
#: Cells of a task.
ROWS = 200_000


def thresholds(sample: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Cuts of one feature: between all its values, or at about equal counts, placed as Spark ML does."""
    values, counts = np.unique(sample, return_counts=True)
    if len(values) <= most + 1:
        return (values[:-1] + values[1:]) / 2
    stride = len(sample) / (most + 1)
    out, target, count = [], stride, counts[0]
    for i in range(1, len(values)):
        before, count = count, count + counts[i]
        if abs(before - target) < abs(count - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out)


def middles(sample: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A value of every bin of one feature: the mean of its sample."""
    at = np.searchsorted(cut, sample)
    n = np.bincount(at, minlength=len(cut) + 1)
    edge = np.append(cut, np.nextafter(cut[-1], np.inf)) if len(cut) else np.zeros(1)
    return np.where(n > 0, np.bincount(at, sample, len(cut) + 1) / np.maximum(n, 1), edge)


class Packed:
    """Cells (``code``: a byte per feature, n, m2, s: label sums) of a table, the thresholds of its features and a value per bin."""

    def __init__(self, cells: DataFrame, cuts: list, classes: int, values: list = ()):
        self.cells, self.cuts, self.classes, self.values = cells.persist(), cuts, classes, values
        # a shuffle's many small partitions would each be a task of every level
        spark = cells.sparkSession
        self.rows = self.cells.coalesce(max(spark.sparkContext.defaultParallelism, -(-self.cells.count() // ROWS))).select("code", "n", "m2", "s")


def _xy(df: DataFrame, fc: str, lc: str) -> DataFrame:
    return df.select(vector_to_array(F.col(fc)).alias("x"), F.col(lc).cast("double").alias("y"))


def _coded(m: np.ndarray, cuts: list) -> np.ndarray:
    """The bins of rows."""
    out = np.zeros((len(m), len(cuts)), np.uint8)
    for f, cut in enumerate(cuts if len(m) else []):
        out[:, f] = np.searchsorted(cut, m[:, f])
    return out


def _cells(rows: DataFrame, cuts: list, classes: int, *by: str) -> DataFrame:
    """Rows (x, y) added up by their bins (and ``by``); s is the sum of y or the counts of the classes, m2 the squares within the cell."""
    @F.arrow_udf("binary")
    def code(x: pa.Array) -> pa.Array:
        out = _coded(matrix(x), cuts)
        return pa.array([], pa.binary()) if not out.size else pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(out.shape[1]), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())

    n = F.count(F.lit(1)).cast("double")
    if classes:
        sums, m2 = F.array(*[F.sum((F.col("y") == k).cast("double")) for k in range(classes)]), F.lit(0.0)
    else:
        sums, m2 = F.array(F.avg("y") * n), F.var_pop("y") * n
    return rows.select(code("x").alias("code"), "y", *by).groupBy("code", *by).agg(n.alias("n"), m2.alias("m2"), sums.alias("s"))


def pack(df: DataFrame, fc: str, lc: str, task: str, seed: int = 42, small: int | None = None) -> Packed | None:
    """The table's cells, persisted; None if it is small, or has labels or features that Spark ML refuses."""
    rows = _xy(df, fc, lc)
    dealt = dealt_out(rows)
    if dealt is not rows:
        rows = dealt.persist()
    try:
        return _packed(rows, task, seed, SMALL if small is None else small)
    finally:
        dealt.unpersist()


def _facts(task: str) -> list:
    """Rows n, whether all are fit for cells, greatest label k, least and greatest number of features."""
    y = F.col("y")
    good = finite(F.col("x")) & y.isNotNull() & ~F.isnan(y)
    if task == "classification":
        good = good & (y >= 0) & (y == F.floor(y))
    return [F.count(F.lit(1)).alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("good"), F.max("y").alias("k"),
            F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")]


def _packed(rows: DataFrame, task: str, seed: int, small: int) -> Packed | None:
    head = rows.agg(*_facts(task)).first()
    n, classes = head["n"], int(head["k"]) + 1 if task == "classification" and head["good"] else 0
    if n <= small or not head["good"] or head["least"] != head["most"] or not head["most"] or classes > CLASSES:
        return None
    some = rows.sample(False, min(1.0, SAMPLE / n), seed) if n > SAMPLE else rows
    x = matrix(some.select("x").toArrow()["x"])                # about SAMPLE rows
    cuts = [thresholds(x[:, f]) for f in range(head["most"])]
    return Packed(_cells(rows, cuts, classes), cuts, classes, [middles(x[:, f], cut) for f, cut in enumerate(cuts)])


def best(n: np.ndarray, s: np.ndarray, least: int):
    """(feature, bin; feature -1 where none may split) of nodes with counts n (nodes, features, bins) and label sums s (.., labels)."""
    total, sums = n[:, 0].sum(1), s[:, 0].sum(1)
    below = n.cumsum(2)[:, :, :-1]
    above = total[:, None, None] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        off = s.cumsum(2)[:, :, :-1] - below[..., None] * (sums / total[:, None])[:, None, None]
        # what rounding leaves of equal means is no decrease
        off[np.abs(off) <= 1e-12 * np.abs(s[:, :1]).sum(2, keepdims=True)] = 0.0
        gain = (off ** 2).sum(3) * (total[:, None, None] / (below * above))
    gain = np.where((below >= least) & (above >= least), gain, 0.0).reshape(len(n), -1)
    top = gain.max(1)
    at = (gain >= top[:, None] * (1 - 1e-9)).argmax(1)
    return np.where(top > 0, at // (n.shape[2] - 1), -1), at % (n.shape[2] - 1)


def _sums(slot: np.ndarray, code: np.ndarray, weights: list, size: int, bins: int) -> np.ndarray:
    """Sums of every weight by (slot, feature, bin): (slots, features, bins, weights)."""
    p = code.shape[1]
    at = ((slot[:, None] * p + np.arange(p)) * bins + code).reshape(-1)
    return np.stack([np.bincount(at, np.repeat(w, p), size * p * bins) for w in weights], 1).reshape(size, p, bins, len(weights))


def _matrix_of(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, n, s) of cells as they come to a task: columns code, n, s."""
    code = table.column("code")
    texts = b"".join((code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).to_pylist())
    rows = len(table.column("n"))
    return np.frombuffer(texts, np.uint8).reshape(rows, -1).astype(np.int64), np.asarray(table.column("n")), matrix(table.column("s"))


def _grow(code: np.ndarray, n: np.ndarray, s: np.ndarray, levels: int, least: int, bins: int) -> tuple[Forest, np.ndarray]:
    """The whole tree of the cells: (tree with cuts as bins, label sums by node with the count first)."""
    tree = Forest(1, 0)
    weights = np.concatenate([n[:, None], s], 1)
    totals = [weights.sum(0)[None]]
    at, start = np.zeros(len(code), np.int64), 0
    step = max(1, HELD // (code.shape[1] * bins * weights.shape[1]))
    for _ in range(levels):
        size = len(tree.feature) - start
        order = np.argsort(at, kind="stable")
        code, weights, at = code[order], weights[order], at[order]
        feature, cut = np.full(size, -1), np.zeros(size, np.int64)
        for first in range(0, size, step):
            some = min(step, size - first)
            a, b = np.searchsorted(at, [start + first, start + first + some])
            got = _sums(at[a:b] - start - first, code[a:b], list(weights[a:b].T), some, bins)
            feature[first: first + some], cut[first: first + some] = best(got[..., 0], got[..., 1:], least)
        grown = np.flatnonzero(feature >= 0)
        if not len(grown):
            break
        # only cells of grown nodes go on
        stay = feature[at - start] >= 0
        code, weights, at = code[stay], weights[stay], at[stay]
        f = feature[at - start]
        right = code[np.arange(len(code)), f] > cut[at - start]
        start, old = len(tree.feature), start
        tree.split(old + grown, feature[grown], cut[grown])
        at = tree.left[at] + right
        totals.append(np.stack([np.bincount(at - start, w, 2 * len(grown)) for w in weights.T], 1))
    return tree, np.concatenate(totals)


def grow(packed: Packed, depth: int, least: int, fc: str, local: int | None = None):
    """Tree of the cells, as a fitted model."""
    local = LOCAL if local is None else local
    rows, cuts, classes = packed.rows, packed.cuts, packed.classes
    spark, p, k = rows.sparkSession, len(cuts), classes or 1
    bins = max(2, 1 + max(len(c) for c in cuts))
    tree = Forest(1, 0)
    totals, small, start, level = None, [], 0, 0
    open_nodes = np.array([0])
    while len(open_nodes):
        slots = np.full(len(tree.feature), -1)
        slots[open_nodes] = np.arange(len(open_nodes))
        sent = spark.sparkContext.broadcast((tree, slots))

        def sums(batches, sent=sent, level=level, size=len(open_nodes)):
            tree, slots = sent.value
            out = np.zeros((size, p, bins, k + 2))
            for b in batches:
                if not b.num_rows:
                    continue
                code, n, s = _matrix_of(b)
                slot = slots[tree.place(code, level)[:, 0]]
                at = slot >= 0
                out += _sums(slot[at], code[at], [np.ones(at.sum()), n[at], *s[at].T], size, bins)
            for i in np.flatnonzero(out[:, 0, :, 0].sum(1)):
                yield int(i), out[i].reshape(-1)

        got = collected(fold(rows, sums, parts=min(len(open_nodes), spark.sparkContext.defaultParallelism)))
        sent.destroy()
        both = np.stack([got[i] for i in range(len(open_nodes))]).reshape(-1, p, bins, k + 2)
        if totals is None:
            totals = both[:, 0, :, 1:].sum(1)
        size = both[:, 0, :, 0].sum(1)
        small.extend(open_nodes[size <= local])
        feature, cut = best(both[..., 1], both[..., 2:], least)
        grown = np.flatnonzero((size > local) & (feature >= 0)) if level < depth else np.array([], int)
        if not len(grown):
            break
        left = np.stack([both[i, feature[i], : cut[i] + 1, 1:].sum(0) for i in grown])
        whole = both[grown, 0, :, 1:].sum(1)
        start = len(tree.feature)
        tree.split(open_nodes[grown], feature[grown], cut[grown])
        totals = np.concatenate([totals, np.stack([left, whole - left], 1).reshape(-1, k + 1)])
        open_nodes = np.arange(start, len(tree.feature))
        level += 1
    if small and depth:
        tree, totals = _finished(rows, tree, totals, np.array(small), level, depth, least, bins, k)
    inner = tree.feature >= 0
    tree.cut[inner] = [cuts[f][int(c)] for f, c in zip(tree.feature[inner], tree.cut[inner], strict=True)]
    value = totals[:, 1:] / totals[:, :1]
    steps = _pruned(tree, value.argmax(1) if classes else value[:, 0])
    at = np.flatnonzero(tree.feature >= 0)
    left, n = tree.left[at], totals[:, 0]
    gain = ((value[left] - value[left + 1]) ** 2).sum(1) * (n[left] * n[left + 1] / n[at])
    gains = np.bincount(tree.feature[at], gain, p)
    return _ForestModel(1, steps, classes, tree.feature, tree.cut, tree.left, value, gains / gains.sum() if gains.sum() > 0 else gains, fc)


def _pruned(tree: Forest, answer: np.ndarray) -> int:
    """Two leaves of one answer become one, from the lowest up, as in Spark ML; the levels that are left."""
    levels = [np.array([0])]
    while len(inner := levels[-1][tree.feature[levels[-1]] >= 0]):
        levels.append(np.concatenate([tree.left[inner], tree.left[inner] + 1]))
    steps = 0
    for i, nodes in reversed([*enumerate(levels)]):
        inner = nodes[tree.feature[nodes] >= 0]
        left = tree.left[inner]
        same = (tree.feature[left] < 0) & (tree.feature[left + 1] < 0) & (answer[left] == answer[left + 1])
        tree.feature[inner[same]], tree.left[inner[same]] = -1, inner[same]
        steps = max(steps, i + 1) if not same.all() else steps
    return steps


def _finished(rows: DataFrame, tree: Forest, totals: np.ndarray, small: np.ndarray, level: int, depth: int, least: int, bins: int, k: int):
    """The tree with the subtrees of its ``small`` nodes, each grown in one task."""
    spark = rows.sparkSession
    slots, depths = np.full(len(tree.feature), -1), np.zeros(len(tree.feature), int)
    slots[small] = small
    for node in np.flatnonzero(tree.feature >= 0):
        depths[tree.left[node]: tree.left[node] + 2] = depths[node] + 1
    sent = spark.sparkContext.broadcast((tree, slots, depths))

    @F.arrow_udf("int")
    def node(code: pa.Array) -> pa.Array:
        tree, slots, _ = sent.value
        if not len(code):
            return pa.array([], pa.int32())
        m = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1)
        return pa.array(slots[tree.place(m, level)[:, 0]].astype(np.int32))

    def subtree(key, table):
        code, n, s = _matrix_of(table)
        # the order of sums does not hang on how the cells arrived
        order = np.lexsort(code.T)
        sub, sums = _grow(code[order], n[order], s[order], depth - sent.value[2][key[0].as_py()], least, bins)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "data": pa.array(
            [b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in (sub.feature, sub.cut, sub.left, sums))], pa.binary())})

    tasks = max(spark.sparkContext.defaultParallelism, min(len(small), 2000))
    # one row per node of at most LOCAL cells: as many numbers as the finished tree has
    found = rows.withColumn("node", node("code")).filter("node >= 0").repartition(tasks, "node").groupBy("node").applyInArrow(subtree, "node int, data binary").collect()
    feature, cut, left, sums, first = [tree.feature], [tree.cut], [tree.left], [totals], len(tree.feature)
    for r in sorted(found, key=lambda r: r["node"]):
        x = np.frombuffer(r["data"], np.float64)
        size = len(x) // (4 + k)
        f, c, le = (x[i * size: (i + 1) * size] for i in range(3))
        s = x[3 * size:].reshape(size, k + 1)
        # the subtree's root is the node itself, its other nodes follow in order
        at, shift = r["node"], first - 1
        feature[0][at], cut[0][at] = int(f[0]), c[0]
        left[0][at] = int(le[0]) + shift if f[0] >= 0 else at
        feature.append(f[1:].astype(np.int32))
        cut.append(c[1:])
        left.append((le[1:] + shift).astype(np.int32))
        sums.append(s[1:])
        first += size - 1
    sent.destroy()
    tree.feature, tree.cut, tree.left = (np.concatenate(a) for a in (feature, cut, left))
    return tree, np.concatenate(sums)


class Tree(Estimator):
    """A decision tree from cells; ``plain`` (Spark ML's estimator of the same tree) fits small tables."""

    def __init__(self, plain, fc: str, lc: str, task: str, depth: int, least: int, seed: int):
        super().__init__()
        self.plain, self.fc, self.lc, self.task, self.depth, self.least, self.seed = plain, fc, lc, task, depth, least, seed

    def _fit(self, df):
        packed = pack(df, self.fc, self.lc, self.task, self.seed)
        if packed is None:
            return self.plain.fit(df)
        try:
            return grow(packed, self.depth, self.least, self.fc)
        finally:
            packed.cells.unpersist()


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1).astype(float)))


def _vector(code: str, values: list):
    """Feature vector of a cell: the value of every bin, by feature."""
    @F.arrow_udf("array<double>")
    def back(code: pa.Array) -> pa.Array:
        m = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1) if len(code) else np.zeros((0, len(values)), np.uint8)
        return _lists(np.stack([v[m[:, f]] for f, v in enumerate(values)], 1))

    return array_to_vector(back(code))


def _inside(cells: DataFrame, cuts: list, fc: str) -> DataFrame:
    """Cells with a feature vector that lies in their bins."""
    return cells.withColumn(fc, _vector("code", [np.append(c, np.nextafter(c[-1], np.inf)) if len(c) else np.zeros(1) for c in cuts]))


def _tested(packed: Packed, rows: DataFrame, fc: str) -> DataFrame:
    """Cells of held-out rows by the thresholds of ``packed``, with a feature vector that lies in the same bins."""
    return _inside(_cells(rows, packed.cuts, packed.classes), packed.cuts, fc).persist()


def _good(tested: DataFrame, classes: int):
    """Accuracy or R^2 of the predictions for cells."""
    n = F.sum("n")
    if classes:
        return F.sum(F.col("s")[F.col("prediction").cast("int")]) / n
    mean = tested.agg(F.sum(F.col("s")[0]) / n).first()[0] or 0.0
    return (1 - F.sum(F.col("m2") + (F.col("s")[0] / F.col("n") - F.col("prediction")) ** 2 * F.col("n"))
            / F.sum(F.col("m2") + (F.col("s")[0] / F.col("n") - mean) ** 2 * F.col("n")))


def search(data: DataFrame, fold: str, folds: int, trees: list[Tree], parallel: int = 4) -> list[list] | None:
    """Per tree the R^2 or accuracy on every held-out fold; the rows of a fold are binned once for all trees.

    None if a fold's other rows are no matter for cells (:func:`pack`).
    """
    out, one = [[] for _ in trees], trees[0]
    for f in range(folds):
        packed = pack(data.where(F.col(fold) != f), one.fc, one.lc, one.task, one.seed)
        if packed is None:
            return None
        tested = _tested(packed, _xy(data.where(F.col(fold) == f), one.fc, one.lc), one.fc)
        good = _good(tested, packed.classes)

        def score(tree, packed=packed, tested=tested, good=good):
            return grow(packed, tree.depth, tree.least, tree.fc).transform(tested).agg(good.alias("s")).first()["s"]

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
            for scores, s in zip(out, ex.map(score, trees), strict=True):
                scores.append(s)
        packed.cells.unpersist()
        tested.unpersist()
    return out


def curve(data: DataFrame, fold: str, folds: int, size: str, sizes: int, tree: Tree) -> list[list[tuple]] | None:
    """Per size and fold (train rows, R^2 or accuracy on them, and on the held-out rows) of ``tree`` on growing train sets.

    ``size`` is the number of the first train set that holds the row, ``sizes`` of a row in none.  Rows are kept nowhere: one pass looks at all, one
    takes the sample, and one per fold adds up its cells, from which every set of the fold is fitted and scored.  A
    fold's thresholds come from a sample of its other rows.  None if a train set is no matter for cells (:func:`pack`).
    """
    fc = tree.fc
    rows = data.select(vector_to_array(F.col(fc)).alias("x"), F.col(tree.lc).cast("double").alias("y"), fold, size)
    head = rows.groupBy(fold, size).agg(*_facts(tree.task)).collect()
    n = [[sum(r["n"] for r in head if r[fold] != f and r[size] <= i) for f in range(folds)] for i in range(sizes)]
    widths = {w for r in head for w in (r["least"], r["most"])}
    if not head or min(map(min, n)) <= SMALL or not all(r["good"] for r in head) or len(widths) > 1 or not max(widths):
        return None
    classes = int(max(r["k"] for r in head)) + 1 if tree.task == "classification" else 0
    if classes > CLASSES:
        return None
    share = SAMPLE * folds / max(1, folds - 1) / sum(r["n"] for r in head)
    some = rows.sample(False, min(1.0, share), tree.seed).select("x", fold).toArrow()
    x, at = matrix(some["x"]), some[fold].to_numpy()
    out = [[] for _ in range(sizes)]
    for f in range(folds):
        cuts = [thresholds(x[at != f, k]) for k in range(x.shape[1])]
        cells = _inside(_cells(rows, cuts, classes, fold, size), cuts, fc).persist()
        held = cells.filter(F.col(fold) == f)
        good = _good(held, classes)
        for i, scores in enumerate(out):
            train = cells.filter((F.col(fold) != f) & (F.col(size) <= i))
            packed = Packed(train, cuts, classes)
            model = grow(packed, tree.depth, tree.least, fc)
            scores.append((n[i][f], model.transform(train).agg(_good(train, classes).alias("s")).first()["s"],
                           model.transform(held).agg(good.alias("s")).first()["s"]))
            packed.cells.unpersist()
        cells.unpersist()
    return out


def boosted(df: DataFrame, booster, fc: str, lc: str, task: str, seed: int, most: int):
    """Gradient boosting from cells: rows of one cell (and class) get equal predictions in every round, so they are one
    weighted row of ``booster`` (Spark ML's).  None for small tables (:func:`pack`) and more than two classes."""
    packed = pack(df, fc, lc, task, seed)
    if packed is None:
        return None
    try:
        if packed.classes > 2:
            return None
        x = packed.rows.select(_vector("code", [np.arange(len(c) + 1.0) for c in packed.cuts]).alias(fc), "n", "s")
        if packed.classes:
            x = x.select(fc, F.posexplode("s").alias(lc, "_w")).filter("_w > 0").withColumn(lc, F.col(lc).cast("double"))
        else:
            x = x.select(fc, (F.col("s")[0] / F.col("n")).alias(lc), F.col("n").alias("_w"))
        return BinnedModel(booster.copy().setWeightCol("_w").fit(dealt_out(x, most, most)), packed.cuts, fc)
    finally:
        packed.cells.unpersist()


class BinnedModel(Model, Stored):
    """A model of bin numbers for rows of values."""

    _fields = ("model", "cuts", "fc")

    def __init__(self, model, cuts, fc):
        super().__init__()
        self.model, self.cuts, self.fc = model, [np.asarray(c) for c in cuts], fc

    @property
    def featureImportances(self):
        return self.model.featureImportances

    def _transform(self, df):
        cuts = self.cuts

        @F.arrow_udf("array<double>")
        def bins(x: pa.Array) -> pa.Array:
            return _lists(_coded(matrix(x), cuts))

        out = df.withColumn("_bins", array_to_vector(bins(vector_to_array(F.col(self.fc)))))
        return self.model.copy().setFeaturesCol("_bins").transform(out).drop("_bins")
