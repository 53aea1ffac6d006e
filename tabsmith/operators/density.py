"""DBSCAN over grid cells.

Points are dealt into cells of side eps / sqrt(d), so two points of one cell are within eps.  A cell with
``min_samples`` rows holds core points only, whatever its size; only the fewer points of the other cells are
counted against the cells around them.  Clusters are the components of cells with core points: two cells
are linked by a pair of core points within eps, which is first sought from the point of either cell nearest to the other
cell's box (one row per neighbouring cell), and only for cells still unlinked among the points within eps of the
other's box.  A cell that holds a third of all rows sends one row to every neighbour; its points stay, in chunks
of ``CHUNK``.

Cells are neighbours if the boxes of their points are within eps; they are found through coarse cells of
the first ``COARSE`` features.

Equal rows are one point with a weight.  A point that is no core point but within eps of one has the cluster of the
nearest core point (of equally near ones the least in the order of the features); all others are noise, -1.  Clusters
are numbered from 0 by their least core point.  Rows with a null or non-finite feature are noise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.graph import components
from tabsmith.functions.stats import prefix_sum
from tabsmith.functions.storage import Stored
from tabsmith.operators.neighbours import finite
from tabsmith.session import cut_lineage

#: Points of one cell that one task compares, and features of the coarse cells.
CHUNK = 4096
COARSE = 3


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _d2(x: str, y: str, width: int) -> Column:
    return _sum([(F.col(x)[i] - F.col(y)[i]) * (F.col(x)[i] - F.col(y)[i]) for i in range(width)])


def _gap2(lo: Column, hi: Column, lo2: Column, hi2: Column, width: int) -> Column:
    """Squared distance of two boxes (a point is a box)."""
    terms = [F.greatest(lo2[i] - hi[i], lo[i] - hi2[i], F.lit(0.0)) for i in range(width)]
    return _sum([t * t for t in terms])


def _ends(width: int, x: str = "x") -> list[Column]:
    return [F.array(*[F.min(F.col(x)[i]) for i in range(width)]).alias("lo"), F.array(*[F.max(F.col(x)[i]) for i in range(width)]).alias("hi")]


class Cells:
    """Points (cid, x, n), cells (cid, cell, rows, points, lo, hi) and neighbouring cells (a, b), each with itself."""

    def __init__(self, rows: DataFrame, eps: float):
        points = rows.filter(finite(F.col("x"))).groupBy("x").agg(F.count("*").alias("n"))
        points = cut_lineage(points)
        head = points.select(F.max(F.size("x"))).first()[0]
        self.eps, self.width = eps, head or 0
        w = max(1, self.width)
        # a little less than eps / sqrt(d): rounding must not put two points of a cell farther apart than eps
        side = eps / w ** 0.5 * (1 - 1e-9)
        cell = F.array(*[F.floor(F.col("x")[i] / F.lit(side)).cast("bigint") for i in range(w)])
        points = points.withColumn("cell", cell)
        cells = points.groupBy("cell").agg(F.sum("n").alias("rows"), F.count("*").alias("points"), *_ends(w))
        cells = cut_lineage(cells)
        self.cells = cut_lineage(cells.withColumn("cid", F.monotonically_increasing_id()))
        self.points = cut_lineage(points.join(self.cells.select("cell", "cid"), "cell").select("cid", "x", "n"))
        step = int(w ** 0.5) + 2                       # coarse cells are wider than eps
        g = min(COARSE, w)
        coarse = [F.floor(F.col("cell")[i] / step).cast("bigint").alias(f"g{i}") for i in range(g)]
        here = self.cells.select(F.col("cid").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), *coarse)
        away = self.cells.select(F.col("cid").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), *coarse)
        for i in range(g):
            away = away.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + o for o in (-1, 0, 1)])))
        near = _gap2(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), w) <= eps * eps
        self.pairs = cut_lineage(away.join(here, [f"g{i}" for i in range(g)]).filter(near).select("a", "b"))


def _chunked(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Points with a chunk of their cell; ``sizes`` has cid and points."""
    chunks = sizes.select("cid", F.ceil(F.col("points") / CHUNK).alias("chunks"))
    return points.join(chunks, "cid").withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks"))).drop("chunks")


def _asked(queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Queries (b, ...) once for every chunk of cell b."""
    chunks = sizes.select(F.col("cid").alias("b"), F.ceil(F.col("points") / CHUNK).alias("chunks"))
    return queries.join(chunks, "b").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def _within(queries: DataFrame, points: DataFrame, sizes: DataFrame, eps: float, width: int) -> DataFrame:
    """Queries (b, q, ...) joined with the points of cell b within eps, as x (and n), with d2."""
    left = _asked(queries, sizes)
    right = _chunked(points, sizes).withColumnRenamed("cid", "b")
    return left.join(right, ["b", "chunk"]).withColumn("d2", _d2("q", "x", width)).filter(F.col("d2") <= eps * eps).drop("chunk")


def clusters(rows: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(x, cluster, core) of every distinct point of ``rows`` (x array<double>)."""
    grid = Cells(rows, eps)
    width, pairs, points, cells = max(1, grid.width), grid.pairs, grid.points, grid.cells
    dense = points.join(cells.filter(F.col("rows") >= min_samples).select("cid"), "cid")
    sparse = cut_lineage(points.join(cells.filter(F.col("rows") < min_samples).select("cid", "rows"), "cid"))
    asked = sparse.select(F.col("cid").alias("a"), F.col("x").alias("q")).join(pairs.filter("a <> b"), "a")
    around = _within(asked, points, cells, eps, width).groupBy("q").agg(F.sum("n").alias("near"))
    judged = sparse.join(around.withColumnRenamed("q", "x"), "x", "left")
    judged = cut_lineage(judged.select("cid", "x", (F.col("rows") + F.coalesce("near", F.lit(0)) >= min_samples).alias("core")))
    core = cut_lineage(dense.select("cid", "x").unionByName(judged.filter("core").select("cid", "x")))
    sizes = cut_lineage(core.groupBy("cid").agg(F.count("*").alias("points"), F.min("x").alias("least"), *_ends(width)))
    linked = _links(core, sizes, pairs, eps, width)
    of = components(linked).withColumnRenamed("node", "cid")
    named = sizes.join(of, "cid", "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    named = cut_lineage(named)
    order = prefix_sum(named.groupBy("component").agg(F.min("least").alias("least")), [], "least", out="cluster").select("component", "cluster")
    named = named.join(order, "component").select("cid", F.col("cluster").cast("int").alias("cluster"))
    inner = core.join(named, "cid").select("x", "cluster", F.lit(True).alias("core"))
    rest = judged.filter("not core").select(F.col("cid").alias("a"), F.col("x").alias("q")).join(pairs, "a")
    best = _within(rest, core, sizes, eps, width).join(named.withColumnRenamed("cid", "b"), "b")
    best = best.groupBy("q").agg(F.min(F.struct("d2", "x", "cluster"))["cluster"].alias("cluster")).withColumnRenamed("q", "x")
    outer = judged.filter("not core").select("x").join(best, "x", "left")
    return inner.unionByName(outer.select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.lit(False).alias("core")))


def _links(core: DataFrame, sizes: DataFrame, pairs: DataFrame, eps: float, width: int) -> DataFrame:
    """(a, b) of cells, a < b, with core points within eps of each other."""
    box = sizes.select(F.col("cid").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    near = pairs.filter("a <> b").join(sizes.select(F.col("cid").alias("a")), "a").join(box, "b")
    point = F.col("x")
    gap = _gap2(point, point, F.col("lo_b"), F.col("hi_b"), width)
    # of every cell towards every neighbour the core point nearest to the neighbour's box
    facing = core.withColumnRenamed("cid", "a").join(near, "a").withColumn("gap", gap).filter(F.col("gap") <= eps * eps)
    best = facing.groupBy("a", "b").agg(F.min(F.struct("gap", "x"))["x"].alias("q"))
    hit = _within(best, core, sizes, eps, width).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hit = cut_lineage(hit)
    # the others: all points that face the neighbour's box
    open_pairs = near.filter("a < b").join(hit, ["a", "b"], "left_anti")
    left = core.withColumnRenamed("cid", "a").join(open_pairs, "a").withColumn("gap", gap).filter(F.col("gap") <= eps * eps)
    more = _within(left.select("a", "b", F.col("x").alias("q")), core, sizes, eps, width).select("a", "b").distinct()
    return hit.unionByName(more)


class DBSCAN(Estimator):
    """The fitted model holds the labelled distinct points."""

    def __init__(self, featuresCol="features", eps=0.5, min_samples=5):
        super().__init__()
        self.fc, self.eps, self.min_samples = featuresCol, eps, min_samples

    def _fit(self, df):
        rows = df.select(vector_to_array(F.col(self.fc)).alias("x"))
        return _DBSCANModel(cut_lineage(clusters(rows, self.eps, self.min_samples)), self.fc)


class _DBSCANModel(Model, Stored):
    """Cluster of the rows that were fitted; other rows are noise."""

    _fields = ("points", "fc")

    def __init__(self, points, fc):
        super().__init__()
        self.points, self.fc = points, fc

    def _transform(self, df):
        named = self.points.select(F.col("x").alias("_x"), F.col("cluster").alias("_cluster"))
        out = df.withColumn("_x", vector_to_array(F.col(self.fc))).join(named, "_x", "left")
        return out.withColumn("cluster", F.coalesce("_cluster", F.lit(-1))).drop("_x", "_cluster")
