"""Exact k nearest neighbours without row pairs.

The reference rows are cut into the leaves of a k-d tree whose cuts come from a bounded sample; every row is in
a leaf, and every leaf has the box of its own rows.  A query is answered in two steps: its home leaf gives
k neighbours and so a greatest distance; then it visits the leaves whose box is not farther than that.  Every visit
returns at most k neighbours, and the best k of all visits are kept by a window that is limited in
every task before the shuffle.  Rows and queries meet only inside a leaf, as NumPy blocks: a matrix product finds the
points that may count, and only their distances are summed exactly.

Skew: equal rows are one point with its k smallest keys, and equal queries are one query, so a value that a third
of all rows has costs one point; a leaf with many queries is visited in chunks of ``CHUNK``.  Queries travel to other
leaves in packs, as bytes.

Neighbours are ordered by squared Euclidean distance (summed feature by feature), then by key.
Rows or queries with a null or non-finite feature have no neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.partials import matrix
from tabsmith.functions.storage import Stored
from tabsmith.session import cut_lineage

#: Rows that a leaf aims at, most leaves, and rows of the sample that places the cuts.
LEAF = 2000
LEAVES = 1 << 16
SAMPLE = 200_000
#: Queries of one leaf that are worked on together, queries whose far leaves are looked for together, distances
#: held at once, groups of points whose least distances bound the k-th, and pairs that are ordered at once.
CHUNK = 20_000
PACK = 4096
BLOCK = 1 << 21
GROUPS = 64
PAIRS = 200_000


def finite(x: Column) -> Column:
    """Whether an array column has only finite numbers."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


class Tree:
    """A complete k-d tree: node i has the children 2i + 1 and 2i + 2; rows at the cut go left."""

    def __init__(self, sample: np.ndarray, depth: int):
        inner = (1 << depth) - 1
        self.depth, self.feature, self.cut = depth, np.zeros(inner, np.int32), np.zeros(inner)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            mine = rows.pop(node)
            part = sample[mine]
            if len(mine):
                f = int(np.argmax(part.max(0) - part.min(0)))
                self.feature[node], self.cut[node] = f, np.partition(part[:, f], (len(mine) - 1) // 2)[(len(mine) - 1) // 2]
                left = part[:, f] <= self.cut[node]
                rows[2 * node + 1], rows[2 * node + 2] = mine[left], mine[~left]
            else:
                rows[2 * node + 1] = rows[2 * node + 2] = mine

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        at = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[at, self.feature[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


class Boxes:
    """Boxes of the leaves and of the inner nodes above them; leaves without rows have none."""

    def __init__(self, depth: int, width: int, leaves: dict[int, tuple[list, list]]):
        self.depth = depth
        n = (1 << depth + 1) - 1
        self.lo, self.hi = np.full((n, width), np.inf), np.full((n, width), -np.inf)
        for leaf, (lo, hi) in leaves.items():
            self.lo[(1 << depth) - 1 + leaf], self.hi[(1 << depth) - 1 + leaf] = lo, hi
        for node in range((1 << depth) - 2, -1, -1):
            self.lo[node] = np.minimum(self.lo[2 * node + 1], self.lo[2 * node + 2])
            self.hi[node] = np.maximum(self.hi[2 * node + 1], self.hi[2 * node + 2])

    def near(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves whose box is within the query's squared distance ``limit``."""
        query, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth + 1):
            # summed in the order of the distances, so rounding never makes a box farther than its rows
            gap = np.zeros(len(query))
            for f in range(x.shape[1]):
                v = x[query, f]
                gap += np.maximum(np.maximum(self.lo[node, f] - v, v - self.hi[node, f]), 0) ** 2
            keep = gap <= limit[query]
            query, node = query[keep], node[keep]
            if level < self.depth:
                query, node = np.repeat(query, 2), np.repeat(2 * node + 1, 2)
                node[1::2] += 1
        return query, node - ((1 << self.depth) - 1)


def _leafed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Rows, whose column ``x`` is an array, with their leaf."""
    @F.arrow_udf("bigint")
    def leaf(x: pa.Array) -> pa.Array:
        return pa.array(tree.leaf(matrix(x)) if len(x) else np.zeros(0, np.int64))

    return rows.withColumn("leaf", leaf("x"))


class Index:
    """Reference points by leaf (``points``: leaf, x, keys), the tree and its boxes."""

    def __init__(self, points: DataFrame, tree: Tree, boxes: Boxes):
        self.points, self.tree, self.boxes = points, tree, boxes


def _best(rows: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of every group; limited in every task before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def build(rows: DataFrame, k: int, leaf_rows: int = LEAF) -> Index:
    """Index of ``rows`` (x array<double>, key) for up to ``k`` neighbours; ``key`` is a number and breaks ties."""
    # a number goes before the array in every sort: arrays are slow to compare
    rows = rows.filter(finite(F.col("x"))).filter("key is not null").withColumn("_h", F.xxhash64("x"))
    points = _best(rows, ["_h", "x"], ["key"], k)
    points = cut_lineage(points.groupBy("_h", "x").agg(F.array_sort(F.collect_list("key")).alias("keys")).drop("_h"))
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    h = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    sample = points.filter(h < F.lit(int(share * (1 << 30)))).select("x").toArrow()
    sample = matrix(sample["x"]) if sample.num_rows else np.zeros((0, 1))
    depth = 0
    while depth < LEAVES.bit_length() - 1 and n > leaf_rows << depth:
        depth += 1
    tree = Tree(sample, depth)
    points = cut_lineage(_leafed(points, tree))
    width = sample.shape[1]
    ends = points.groupBy("leaf").agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(width) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    # one row per leaf, at most LEAVES
    boxes = {r["leaf"]: ([r[f"lo{i}"] for i in range(width)], [r[f"hi{i}"] for i in range(width)]) for r in ends.collect()} if n else {}
    return Index(points, tree, Boxes(depth, width, boxes))


def _top(p: np.ndarray, keys: pa.Array, q: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, d2, key) of the best k keys of the points ``p`` within ``limit`` of every query, ordered by query, d2, key.

    A matrix product gives distances about right; those that may count, by a bound that covers its rounding, are summed again feature by feature.
    """
    width = p.shape[1]
    starts = keys.offsets.to_numpy()
    times, starts, flat = np.diff(starts), starts[:-1] - starts[0], keys.flatten().to_numpy(zero_copy_only=False)
    # overflows make a bound that is not a number, and then all points count
    with np.errstate(over="ignore", invalid="ignore"):
        centre = p.mean(0)
        around = p - centre
        size = (around ** 2).sum(1)
        largest = size.max()
    groups = min(len(p), max(GROUPS, k))
    even = len(p) // groups * groups
    out = [(np.zeros(0, np.int64), np.zeros(0), flat[:0])]
    step = max(1, BLOCK // len(p))
    for s in range(0, len(q), step):
        x, most = q[s: s + step], limit[s: s + step]
        with np.errstate(over="ignore", invalid="ignore"):
            c = x - centre
            own = (c ** 2).sum(1)
            # squared distances less the query's own square, each wrong by at most ``slack``
            near = (-2 * c) @ around.T
            near += size
            slack = 64 * (width + 8) * np.finfo(float).eps * (own + largest)
            bound = most * (1 + 1e-12) - own + slack
            if k <= groups:
                # the least distances of k groups belong to k points, so the k-th best is not farther
                least = near[:, :even].reshape(len(x), -1, groups).min(1)
                bound = np.minimum(bound, np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * slack)
            query, point = np.nonzero(~(near > bound[:, None]))
        first = np.searchsorted(query, np.arange(len(x) + 1))
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(first, first[i] + PAIRS, "right")) - 1)
            at, of = query[first[i]: first[j]], point[first[i]: first[j]]
            i = j
            d = np.zeros(len(at))
            with np.errstate(over="ignore"):
                for f in range(width):
                    d += (x[at, f] - p[of, f]) ** 2
            keep = d <= most[at]
            at, of, d = at[keep], of[keep], d[keep]
            n = times[of]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, d, key = np.repeat(at, n), np.repeat(d, n), flat[np.repeat(starts[of], n) + nth]
            order = np.lexsort((key, d, at))
            at, d, key = at[order], d[order], key[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append((at[best] + s, d[best], key[best]))
    return tuple(np.concatenate(o) for o in zip(*out, strict=True))


def _met(points: DataFrame, queries: DataFrame, rows: str, work, schema: str) -> DataFrame:
    """``work`` on the points and the queries of every leaf; ``rows`` says how many queries a row of ``queries`` has."""
    counts = queries.groupBy("leaf").agg(F.ceil(F.sum(F.expr(rows)) / CHUNK).alias("chunks"))
    left = points.join(counts, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # reference rows and queries may come from one table: the columns of this side get their own identity
    left = left.select(*[F.col(n).alias(n) for n in ("leaf", "chunk", "x", "keys")])
    right = queries.join(counts, "leaf").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks"))).drop("chunks")
    return left.groupBy("leaf", "chunk").cogroup(right.groupBy("leaf", "chunk")).applyInArrow(work, schema)


def _at_home(points: DataFrame, home: DataFrame, k: int) -> DataFrame:
    """Every query with the best k of its own leaf (``ds``, ``keys``) and the distance beyond which no row can count (``d2``)."""
    kind = dict(points.dtypes)["keys"][6:-1]
    number = pa.int64() if kind == "bigint" else pa.float64()

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        n = asked.num_rows
        at, d, key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if rows.num_rows and n:
            at, d, key = _top(matrix(rows["x"]), rows["keys"].combine_chunks(), matrix(asked["x"]), np.full(n, np.inf), k)
        ends = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
        limit = np.full(n, np.inf)
        full = np.diff(ends) >= k
        limit[full] = d[ends[1:][full] - 1]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t)) for v, t in ((d, pa.float64()), (key, number))]
        return pa.table([asked["qid"], asked["leaf"], asked["x"].cast(pa.list_(pa.float64())), pa.array(limit), *lists], names=["qid", "leaf", "x", "d2", "ds", "keys"])

    return _met(points, home, "1", work, f"qid bigint, leaf bigint, x array<double>, d2 double, ds array<double>, keys array<{kind}>")


def _away(points: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """(qid, d2, key) of the best k of every visit of another leaf; a row of ``packs`` has many queries of one leaf."""
    kind = dict(points.dtypes)["keys"][6:-1]
    number = pa.int64() if kind == "bigint" else pa.float64()

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, at, d, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if rows.num_rows and asked.num_rows:
            ids, q, limit = (np.frombuffer(b"".join(asked[c].to_pylist()), t) for c, t in (("ids", np.int64), ("xs", np.float64), ("limits", np.float64)))
            at, d, key = _top(matrix(rows["x"]), rows["keys"].combine_chunks(), q.reshape(len(ids), -1), limit, k)
        return pa.table([pa.array(ids[at]), pa.array(d), pa.array(key, number)], names=["qid", "d2", "key"])

    return _met(points, packs, "n", work, f"qid bigint, d2 double, key {kind}")


def nearest(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(qid, d2, key): the k nearest reference rows of every query (qid bigint unique, x array<double>)."""
    queries = queries.filter(finite(F.col("x"))).select("qid", "x")
    tree, boxes = index.tree, index.boxes
    home = cut_lineage(_at_home(index.points, cut_lineage(_leafed(queries, tree)), k))

    def others(batches):
        for b in batches:
            x = matrix(b.column(2))
            for s in range(0, len(x), PACK):
                part, mine = b.slice(s, PACK), x[s: s + PACK]
                ids, own, limit = (part.column(c).to_numpy() for c in (0, 1, 3))
                query, leaf = boxes.near(mine, limit)
                far = leaf != own[query]
                order = np.argsort(leaf[far], kind="stable")
                query, leaf = query[far][order], leaf[far][order]
                if len(leaf):
                    ends = np.flatnonzero(np.append(np.diff(leaf) != 0, True)) + 1
                    runs = [query[i:j] for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r[0]] for r in runs], pa.int64()), pa.array(leaf[ends - 1]), pa.array([len(r) for r in runs], pa.int64()),
                         *[pa.array([np.ascontiguousarray(v[r]).tobytes() for r in runs], pa.binary()) for v in (ids, mine, limit)]],
                        names=["qid", "leaf", "n", "ids", "xs", "limits"])

    packs = home.mapInArrow(others, "qid bigint, leaf bigint, n bigint, ids binary, xs binary, limits binary")
    first = home.select("qid", F.inline(F.arrays_zip(F.col("ds").alias("d2"), F.col("keys").alias("key"))))
    return _best(first.unionByName(_away(index.points, cut_lineage(packs), k)), ["qid"], ["d2", "key"], k)


class KNearest(Estimator):
    """Majority (``classification``) or mean (``regression``) of the k nearest training labels.

    Ties of distance go to the smaller label, ties of votes to the smallest class.
    """

    def __init__(self, featuresCol="features", labelCol="label", k=5, task="classification"):
        super().__init__()
        self.fc, self.lc, self.k, self.task = featuresCol, labelCol, k, task

    def _fit(self, df):
        rows = df.select(vector_to_array(F.col(self.fc)).alias("x"), F.col(self.lc).cast("double").alias("key"))
        classes = int(df.agg(F.max(self.lc)).first()[0] or 0) + 1 if self.task == "classification" else 0
        index = build(rows, self.k)
        tree, boxes = index.tree, index.boxes
        return _KNearestModel(index.points, tree.depth, tree.feature, tree.cut, boxes.lo, boxes.hi, self.k, classes, self.fc)


class _KNearestModel(Model, Stored):
    _fields = ("points", "depth", "feature", "cut", "lo", "hi", "k", "classes", "fc")

    def __init__(self, points, depth, feature, cut, lo, hi, k, classes, fc):
        super().__init__()
        self.points, self.depth, self.feature, self.cut, self.lo, self.hi = points, depth, feature, cut, lo, hi
        self.k, self.classes, self.fc = k, classes, fc

    def _index(self) -> Index:
        tree, boxes = Tree.__new__(Tree), Boxes.__new__(Boxes)
        tree.depth, tree.feature, tree.cut = self.depth, np.asarray(self.feature), np.asarray(self.cut)
        boxes.depth, boxes.lo, boxes.hi = self.depth, np.asarray(self.lo), np.asarray(self.hi)
        return Index(self.points, tree, boxes)

    def _transform(self, df):
        x = vector_to_array(F.col(self.fc))
        distinct = df.select(x.alias("x")).filter(finite(F.col("x"))).distinct()
        queries = cut_lineage(distinct.withColumn("qid", F.monotonically_increasing_id()))
        found = nearest(queries, self._index(), self.k)
        if self.classes:
            votes = found.groupBy("qid").agg(*[F.avg((F.col("key") == c).cast("double")).alias(f"_{c}") for c in range(self.classes)])
            shares = F.array(*[F.col(f"_{c}") for c in range(self.classes)])
            answer = votes.select("qid", array_to_vector(shares).alias("probability"),
                                  (F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("prediction"))
        else:
            answer = found.groupBy("qid").agg(F.avg("key").alias("prediction"))
        answers = queries.join(answer, "qid").drop("qid").withColumnRenamed("x", "_x").withColumn("_h", F.xxhash64("_x"))
        return df.withColumn("_x", x).withColumn("_h", F.xxhash64("_x")).join(answers, ["_h", "_x"], "left").drop("_h", "_x")
