"""Explanations as batch jobs.

Every explainer is "expand rows -> score once -> aggregate": the expansion
is an ``explode`` over a bounded list (grid points, features x {-1,+1},
candidates, permutations), never a join of rows with rows.  Scoring goes
through a :class:`Scorer` -- a fitted Spark model or a SQL expression over
the feature columns (U2) -- applied to the whole expanded table at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabsmith.functions.columns import c, hash_uniform, md5_uniform
from tabsmith.functions.partials import dealt_out
from tabsmith.functions.stats import quantile_dict


@dataclass
class Scorer:
    """Adds ``prediction`` (and ``p1`` = P(class 1) when available) to a table of feature columns."""
    fn: Callable[[DataFrame], DataFrame]
    features: list

    @classmethod
    def sql(cls, expr: str, features, proba_expr: str | None = None) -> "Scorer":
        def fn(df):
            out = df.withColumn("prediction", F.expr(expr))
            return out.withColumn("p1", F.expr(proba_expr)) if proba_expr else out
        return cls(fn, list(features))

    @classmethod
    def model(cls, model, features) -> "Scorer":
        from pyspark.ml.functions import vector_to_array
        va = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")

        def fn(df):
            m = model.copy()
            for name in ("featuresCol",):
                if m.hasParam(name):
                    m = m.copy({m.getParam(name): "__features"})
            out = m.transform(va.transform(df))
            drop = [x for x in ("__features", "rawPrediction") if x in out.columns]
            if "probability" in out.columns:
                out = out.withColumn("p1", vector_to_array("probability")[1]).drop("probability")
            return out.drop(*drop)
        return cls(fn, list(features))

    def __call__(self, df):
        return self.fn(df)


def _replace(df: DataFrame, feature: str, value) -> DataFrame:
    return df.withColumn(feature, value)


# ------------------------------------------------------------------ X2 / X4

def linear_shap(df: DataFrame, coef: dict, keys, means: dict | None = None) -> DataFrame:
    """Exact Shapley values of a linear model: coef_j * (x_j - mean_j), long form.

    Means come from one aggregate over ``df`` unless given.  Sum over j equals
    prediction - mean prediction.
    """
    feats = list(coef)
    if means is None:
        r = df.agg(*[F.avg(c(f)).alias(f) for f in feats]).first()
        means = {f: r[f] for f in feats}
    structs = [F.struct(F.lit(f).alias("feature"), (F.lit(float(coef[f])) * (c(f) - F.lit(float(means[f]))))
                        .alias("shap")) for f in feats]
    return df.select(*[c(k) for k in keys], F.inline(F.array(*structs)))


def top_drivers(df: DataFrame, coef: dict, keys, k: int = 8, means: dict | None = None) -> DataFrame:
    """Of a row's k largest |contributions|, at most k/2 that push up (> 0) and k/2 that push down (< 0).

    Contributions are ranked inside the row's own array: ``keys`` only label the output, need not
    identify rows, and nothing is shuffled.
    """
    feats = list(coef)
    if means is None:
        r = df.agg(*[F.avg(c(f)).alias(f) for f in feats]).first()
        means = {f: r[f] for f in feats}
    parts = []
    for f in feats:
        v = F.lit(float(coef[f])) * (c(f) - F.lit(float(means[f])))
        parts.append(F.struct((-F.abs(v)).alias("rank"), F.lit(f).alias("feature"), v.alias("shap")))
    top = F.slice(F.array_sort(F.filter(F.array(*parts), lambda s: s["shap"].isNotNull())), 1, k)
    half = max(1, k // 2)
    def side(name, keep):
        return F.transform(F.slice(F.filter(F.col("__top"), keep), 1, half),
                           lambda s: F.struct(s["feature"].alias("feature"), s["shap"].alias("shap"), F.lit(name).alias("direction")))
    both = F.concat(side("up", lambda s: s["shap"] > 0), side("down", lambda s: s["shap"] < 0))
    return df.select(*[c(x) for x in keys], top.alias("__top")).select(*keys, F.inline(both))


# ------------------------------------------------------------------ X5 / X6 partial dependence

def grid_values(df: DataFrame, feature: str, n: int = 20) -> list[float]:
    """Equal-spaced grid between min and max (n points)."""
    r = df.agg(F.min(c(feature)).alias("lo"), F.max(c(feature)).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


def partial_dependence(df: DataFrame, scorer: Scorer, feature: str, grid=None, n: int = 20) -> DataFrame:
    """Mean prediction with ``feature`` set to each grid value (rows x grid expansion)."""
    grid = grid if grid is not None else grid_values(df, feature, n)
    ex = df.select(*[c(f) for f in scorer.features if f != feature],
                   F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias(feature))
    return scorer(ex).groupBy(F.col(feature).alias("grid")).agg(F.avg("prediction").alias("pd"))


def partial_dependence_2d(df: DataFrame, scorer: Scorer, f1: str, f2: str, n: int = 10) -> DataFrame:
    """Mean prediction on the n x n grid of two features."""
    g1, g2 = grid_values(df, f1, n), grid_values(df, f2, n)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in g1 for b in g2])
    ex = df.select(*[c(f) for f in scorer.features if f not in (f1, f2)], F.inline(pairs))
    ex = ex.withColumnRenamed("a", f1).withColumnRenamed("b", f2)
    return scorer(ex).groupBy(F.col(f1).alias("grid1"), F.col(f2).alias("grid2")).agg(F.avg("prediction").alias("pd"))


# ------------------------------------------------------------------ X7 accumulated local effects

def ale(df: DataFrame, scorer: Scorer, feature: str, bins: int = 10) -> DataFrame:
    """X7 (Apley & Zhu): quantile bins; per row the prediction difference between the bin's upper
    and lower edge; mean per bin, cumulated, centred by the count-weighted mean effect.

    Bin k (1-based) holds edge[k-1] < x <= edge[k]; the minimum falls in bin 1.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = quantile_dict(df, [feature], probs)[feature]
    e = F.array(*[F.lit(float(v)) for v in edges])
    x = c(feature)
    k = F.greatest(F.lit(1), F.least(F.lit(bins), F.size(F.filter(e, lambda v: v < x))))
    base = df.select(*[c(f) for f in scorer.features], k.alias("__bin"))
    both = base.withColumn("__lo", F.element_at(e, F.col("__bin"))).withColumn("__hi", F.element_at(e, F.col("__bin") + 1))
    # score lower and upper edge in one expanded pass (2 rows per input row)
    ex = both.select(*[c(f) for f in scorer.features if f != feature], "__bin",
                     F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("__lo").alias("v")),
                                       F.struct(F.lit(1).alias("s"), F.col("__hi").alias("v")))).alias("__e"))
    ex = ex.select("*", F.col("__e.s").alias("__side"), F.col("__e.v").alias(feature)).drop("__e")
    sc = scorer(ex)
    per_bin = sc.groupBy("__bin").agg(
        (F.sum(F.when(F.col("__side") == 1, F.col("prediction")).otherwise(-F.col("prediction")))
         / F.count_if(F.col("__side") == 1)).alias("effect"),
        F.count_if(F.col("__side") == 1).alias("n"))
    w = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)   # <= bins rows
    cum = per_bin.withColumn("ale", F.sum("effect").over(w))
    centre = cum.agg((F.sum(F.col("ale") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    return cum.select(F.col("__bin").alias("bin"), F.element_at(e, F.col("__bin") + 1).alias("upper_edge"), "n",
                      (F.col("ale") - F.lit(float(centre))).alias("ale"))


# ------------------------------------------------------------------ X10 what-if sensitivity

def what_if(df: DataFrame, scorer: Scorer, keys, features=None) -> DataFrame:
    """Per row and feature, the prediction at x_j - / + one sample std (ddof 1), with the base.

    A row expands to one row per feature, which is scored three times on derived columns (below,
    above, as it is): nothing is shuffled and rows need no key; ``keys`` only label the output.
    """
    feats = list(features or scorer.features)
    sd = df.agg(*[F.stddev_samp(c(f)).alias(f) for f in feats]).first()
    label = [f"__k{i}" for i in range(len(keys))]
    held = {f: f"__x{i}" for i, f in enumerate(scorer.features)}
    steps = F.array(*[F.struct(F.lit(f).alias("__f"), F.lit(float(sd[f] or 0.0)).alias("__s")) for f in feats])
    cur = df.select(*[c(k).alias(a) for k, a in zip(keys, label)], *[c(f).alias(a) for f, a in held.items()], F.inline(steps))
    keep = [*label, *held.values(), "__f", "__s"]
    for name, sign in (("__minus", -1), ("__plus", 1), ("__base", 0)):
        inputs = [(F.when(F.col("__f") == f, F.col(a) + sign * F.col("__s")).otherwise(F.col(a)) if sign and f in feats
                   else F.col(a)).alias(f) for f, a in held.items()]
        cur = scorer(cur.select(*keep, *inputs)).withColumnRenamed("prediction", name).select(*keep, name)
        keep.append(name)
    return cur.select(*[F.col(a).alias(k) for k, a in zip(keys, label)], F.col("__f").alias("feature"),
                      F.col("__minus").alias("minus"), F.col("__plus").alias("plus"), F.col("__base").alias("base"))


# ------------------------------------------------------------------ X11, X12, X17

def error_analysis(pred: DataFrame, label="label", prediction="prediction", p1="p1", group=("model",)) -> DataFrame:
    """X11: misclassified count and mean confidence (max class probability) on the wrong rows."""
    g = [x for x in group if x in pred.columns]
    conf = F.greatest(F.col(p1), 1 - F.col(p1))
    wrong = F.col(label) != F.col(prediction)
    return pred.groupBy(*g).agg(F.count_if(wrong).alias("misclassified"),
                                F.avg(F.when(wrong, conf)).alias("mean_conf_wrong"),
                                F.count(F.lit(1)).alias("n"))


def hard_examples(pred: DataFrame, keys, label="label", prediction="prediction", k: int = 10) -> DataFrame:
    """The k largest |residual| (ties -> key order); a top-k report, planned as TakeOrderedAndProject."""
    r = F.col(label) - F.col(prediction)
    return pred.select(*[c(x) for x in keys], label, prediction, r.alias("residual")) \
        .orderBy(F.abs("residual").desc(), *[c(x) for x in keys]).limit(k)


def group_premium(df: DataFrame, group: str, target: str) -> DataFrame:
    """Group mean of the target minus the overall mean."""
    overall = df.agg(F.avg(c(target))).first()[0]
    return df.groupBy(c(group).alias("grp")).agg(F.avg(c(target)).alias("group_mean"), F.count(F.lit(1)).alias("n")) \
        .withColumn("premium", F.col("group_mean") - F.lit(float(overall)))


# ------------------------------------------------------------------ X16 decision surface

def decision_surface(df: DataFrame, scorer: Scorer, f1: str, f2: str, n: int = 120) -> DataFrame:
    """N x n grid over two features' ranges, other features at their (exact) medians."""
    others = [f for f in scorer.features if f not in (f1, f2)]
    med = quantile_dict(df, others, [0.5]) if others else {}
    g1, g2 = grid_values(df, f1, n), grid_values(df, f2, n)
    spark = df.sparkSession
    a = spark.createDataFrame([(i, v) for i, v in enumerate(g1)], f"i int, `{f1}` double")
    grid = a.select("i", c(f1), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(v).alias("v"))
                                                    for j, v in enumerate(g2)])).alias("__b"))
    grid = grid.select("i", c(f1), F.col("__b.j").alias("j"), F.col("__b.v").alias(f2),
                       *[F.lit(float(med[o][0])).alias(o) for o in others])
    out = scorer(grid)
    val = F.col("p1") if "p1" in out.columns else F.col("prediction")
    return out.select("i", "j", c(f1), c(f2), val.alias("value"))


# ------------------------------------------------------------------ X1 permutation importance

def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of the row numbers ``i`` under a keyed permutation of 0 ... n - 1 (a Feistel network with cycle walking)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    out = i.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            mixed = (right * 0x9E3779B1 + key * 0x85EBCA77 + turn * 0xC2B2AE3D) & 0xFFFFFFFF
            mixed = (mixed ^ (mixed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
            mixed = (mixed ^ (mixed >> 12)) * 0x297A2D39 & 0xFFFFFFFF
            left, right = right, left ^ ((mixed ^ (mixed >> 15)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``__pos`` 0 ... n - 1 in the order of the kept partitions, and n; nothing is sorted or shuffled."""
    from tabsmith.session import cut_lineage
    rows = cut_lineage(df).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)          # one row per partition
    starts = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    n = sizes.agg(F.sum("__n")).first()[0] or 0
    rows = rows.join(starts, "__part").withColumn("__pos", F.col("__id") - F.col("__first") + F.col("__start"))
    return rows.drop("__id", "__part", "__first", "__start"), n


#: Rows whose permuted values are put together before they go to the shuffle.
DEALT = 1 << 18


def _dealt(n: int, bits: int, width: int, repeats: int, seed: int):
    """(row number, features) -> per block of 2^bits numbers and feature: how many values every repeat sends there (counts),
    their places in the block (at), the values or their numbers in ``known``, and which of them are null (missing)."""
    blocks = ((n - 1) >> bits) + 1
    names = ["block", "feature", "counts", "at", "data", "known", "missing"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def send(pos: np.ndarray, column: pa.Array, j: int) -> pa.RecordBatch:
        to = np.concatenate([permuted(pos, n, seed * 1_000_003 + j * repeats + r) for r in range(repeats)])
        block, rep = to >> bits, np.repeat(np.arange(repeats), len(pos))
        order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
        counts = np.bincount(block * repeats + rep, minlength=blocks * repeats).reshape(blocks, repeats).astype(np.uint32)
        values, null = column.to_numpy(zero_copy_only=False).astype(float), column.is_null().to_numpy(zero_copy_only=False)
        # bit patterns, so that every number and NaN comes back as it was
        known, code = np.unique(values.view(np.int64), return_inverse=True)
        few = len(known) <= 256
        data = np.tile(code.astype(np.uint8) if few else values, repeats)[order]
        at, null = (to & ((1 << bits) - 1)).astype(np.uint16)[order], np.tile(null, repeats)[order] if null.any() else None
        table, ends = known.tobytes() if few else b"", np.concatenate([[0], np.cumsum(counts.sum(1, dtype=np.int64))])
        out = [[] for _ in names]
        for b in np.flatnonzero(np.diff(ends)):
            part = slice(ends[b], ends[b + 1])
            lost = np.packbits(null[part]).tobytes() if null is not None else b""
            for to_, x in zip(out, (b, j, counts[b].tobytes(), at[part].tobytes(), data[part].tobytes(), table, lost), strict=True):
                to_.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    def flushed(held: list):
        rows = pa.Table.from_batches(held).combine_chunks()
        pos = rows.column(0).to_numpy()
        for j in range(width):
            yield send(pos, pa.concat_arrays(rows.column(1 + j).chunks), j)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= DEALT:
                yield from flushed(held)
                held, size = [], 0
        if held:
            yield from flushed(held)

    return run


def _met(bits: int, width: int, repeats: int):
    """A block's rows and the values sent to it -> the rows with ``__v``, a value per feature and repeat."""
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        place = rows["__pos"].to_numpy() & ((1 << bits) - 1)
        value, null = np.zeros((width * repeats, 1 << bits)), np.zeros((width * repeats, 1 << bits), bool)
        for _, j, counts, at, data, known, missing in zip(*(x.to_pylist() for x in sent.columns), strict=True):
            at = np.frombuffer(at, np.uint16)
            slot = j * repeats + np.repeat(np.arange(repeats), np.frombuffer(counts, np.uint32))
            value[slot, at] = np.frombuffer(known, float)[np.frombuffer(data, np.uint8)] if known else np.frombuffer(data, float)
            if missing:
                null[slot, at] = np.unpackbits(np.frombuffer(missing, np.uint8), count=len(at)).astype(bool)
        flat = pa.array(value[:, place].T.ravel(), pa.float64(), mask=null[:, place].T.ravel())
        ends = np.arange(len(place) + 1, dtype=np.int32) * np.int32(width * repeats)
        return rows.append_column("__v", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))

    return run


def permutation_importance(df: DataFrame, scorer: Scorer, label: str, keys, metric: str = "r2",
                           repeats: int = 5, seed: int = 42, top: int = 20) -> DataFrame:
    """Score drop when one feature's column is permuted (per feature x repeat).

    Rows are numbered as they lie.  For every feature and repeat a keyed permutation of the numbers says
    which row gets a row's value.  Numbers are cut into blocks; a task sends the values that go to one block as
    arrays of places and values, a byte per value where it has few distinct ones.  A block's rows meet the arrays
    once, and a row's variants are scored in place.
    """
    feats = list(scorer.features)
    base, n = numbered(df.select(*[c(f).cast("double").alias(f) for f in feats], c(label).alias("__y")))
    slots = [(j, r) for j in range(len(feats)) for r in range(repeats)]
    # blocks of numbers, about a thousand: their rows and the values that go there meet in one task
    bits = min(16, max(12, n.bit_length() - 10))
    block = F.shiftright("__pos", bits)
    sent = base.select("__pos", *[c(f) for f in feats]).mapInArrow(
        _dealt(n, bits, len(feats), repeats, seed), "block bigint, feature int, counts binary, at binary, data binary, known binary, missing binary")
    rows = base.select(block.alias("block"), "*")
    both = rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(
        _met(bits, len(feats), repeats), T.StructType([*rows.schema.fields, T.StructField("__v", T.ArrayType(T.DoubleType()))]))
    variant = [F.struct(F.lit(feats[j]).alias("feature"), F.lit(r).alias("rep"),
                        *[(F.col("__v")[k] if i == j else c(f)).alias(f) for i, f in enumerate(feats)], F.col("__y"))
               for k, (j, r) in enumerate(slots)]
    sc = scorer(both.select(F.inline(F.array(*variant))))
    full = scorer(base)
    y = F.col("__y").cast("double")

    def score(d, g):
        if metric == "accuracy":
            return d.groupBy(*g).agg(F.avg((F.col("__y") == F.col("prediction")).cast("double")).alias("s"))
        return d.groupBy(*g).agg((1 - F.avg((y - F.col("prediction")) ** 2) / F.var_pop(y)).alias("s"))
    base_score = score(full, []).first()["s"]
    per = score(sc, ["feature", "rep"])
    out = per.groupBy("feature").agg((F.lit(float(base_score)) - F.avg("s")).alias("importance_mean"),
                                     F.stddev_pop(F.lit(float(base_score)) - F.col("s")).alias("importance_std"))
    return out.orderBy(F.abs("importance_mean").desc(), "feature").limit(top)


# ------------------------------------------------------------------ X13, Q9 projections

def principal_components(df: DataFrame, features, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components (features x k), variances) from one Gram pass; a component's greatest element is positive."""
    from tabsmith.operators.estimators import gram
    va = VectorAssembler(inputCols=list(features), outputCol="__f", handleInvalid="skip")
    g = gram(va.transform(df.select(*[c(f).cast("double").alias(f) for f in features])), "__f")
    mean = g["s"] / g["n"]
    values, vectors = np.linalg.eigh(g["G"] / g["n"] - np.outer(mean, mean))
    w = vectors[:, ::-1][:, :k]
    return mean, w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])]), values[::-1][:k]


def project(df: DataFrame, features, mean: np.ndarray, w: np.ndarray) -> DataFrame:
    """Columns c1 ... ck: the centred features times the components, as plain expressions."""
    for j in range(w.shape[1]):
        terms = [(c(f).cast("double") - F.lit(float(m))) * F.lit(float(x)) for f, m, x in zip(features, mean, w[:, j], strict=True)]
        df = df.withColumn(f"c{j + 1}", sum(terms[1:], terms[0]))
    return df


def error_projection(df: DataFrame, features, error, k: int = 2) -> DataFrame:
    """Every scored row with its ``error`` (an expression) and its place on the first ``k`` principal components."""
    mean, w, _ = principal_components(df, features, k)
    return project(df.withColumn("error", error), features, mean, w)


# ------------------------------------------------------------------ X9 counterfactuals

def counterfactuals(df: DataFrame, scorer: Scorer, keys, n_candidates: int = 300, max_changes: int = 4,
                    regression_move: float = 0.05, seed: int = 42, task: str = "classification") -> DataFrame:
    """Per row, ``n_candidates`` candidates changing up to ``max_changes`` features to hash-uniform
    values in the observed [min, max]; keep the nearest (L2 in range-scaled units) that flips the
    class (or moves a regression prediction by more than 5 %)."""
    feats = list(scorer.features)
    mm = df.agg(*[F.min(c(f)).alias(f"lo_{f}") for f in feats], *[F.max(c(f)).alias(f"hi_{f}") for f in feats]).first()
    # every row becomes n_candidates: a table in few partitions is dealt out first
    base = scorer(dealt_out(df.select(*[c(k) for k in keys], *[c(f) for f in feats]), 100)).withColumnRenamed("prediction", "__p0")
    if "p1" in base.columns:
        base = base.drop("p1")
    # the original values travel with the candidate: no join back
    base = base.select("*", *[c(f).alias(f"__orig{j}") for j, f in enumerate(feats)])
    nf = len(feats)
    most = min(max_changes, nf)
    ex = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_candidates))).alias("__cand"))
    for j, f in enumerate(feats):
        lo, hi = float(mm[f"lo_{f}"]), float(mm[f"hi_{f}"])
        u_val = md5_uniform([*keys, "__cand", F.lit(f"val{j}")], seed)
        ex = ex.withColumn(f"__new{j}", F.lit(lo) + u_val * F.lit(hi - lo))
        if most < nf:
            # feature j changes when it is among the candidate's first max_changes hash-ranked features
            ex = ex.withColumn(f"__pick{j}", md5_uniform([*keys, "__cand", F.lit(f"pick{j}")], seed))
    kth = F.element_at(F.array_sort(F.array(*[F.col(f"__pick{j}") for j in range(nf)])), most) if most < nf else F.lit(1.0)
    ex = ex.withColumn("__kth", kth)
    for j, f in enumerate(feats):
        new = F.col(f"__new{j}")
        ex = ex.withColumn(f, F.when(F.col(f"__pick{j}") <= F.col("__kth"), new).otherwise(c(f)) if most < nf else new)
    dist = F.sqrt(sum((((c(f) - F.col(f"__orig{j}")) / F.lit(max(1e-12, float(mm[f"hi_{f}"]) - float(mm[f"lo_{f}"])))) ** 2
                       for j, f in enumerate(feats)), F.lit(0.0)))
    sc = scorer(ex)
    if task == "classification":
        hit = F.col("prediction") != F.col("__p0")
    else:
        hit = F.abs(F.col("prediction") - F.col("__p0")) > F.lit(regression_move) * F.abs(F.col("__p0"))
    # the hits are told apart inside the aggregate, one pass over the candidates.  One buffer per feature, not one struct, keeps the aggregate a hash aggregate: candidates are not sorted.
    sc = sc.withColumn("__hit", hit).withColumn("__d", F.when(F.col("__hit"), dist))
    best = sc.groupBy(*[c(k) for k in keys]).agg(
        *[F.min_by(c(f), "__d").alias(f"__cf{j}") for j, f in enumerate(feats)], F.min_by("prediction", "__d").alias("__cfp"),
        F.min("__d").alias("distance"), F.first(F.when(F.col("__hit"), F.col("__p0")), ignorenulls=True).alias("prediction"),
        F.max("__hit").alias("__any"))
    cf = F.struct(*[F.col(f"__cf{j}").alias(f) for j, f in enumerate(feats)], F.col("__cfp").alias("new_prediction"))
    return best.where("__any").select(*[c(k) for k in keys], F.when(F.col("distance").isNotNull(), cf).alias("cf"), "distance", "prediction")


# ------------------------------------------------------------------ X3 sampling Shapley

def sampling_shap(df: DataFrame, scorer: Scorer, keys, background: DataFrame, n_perm: int = 10,
                  seed: int = 42) -> DataFrame:
    """X3 (Strumbelj & Kononenko 2014): Shapley values of any scorer by permutation sampling.

    For each row and sample m: a hash permutation of the features and a
    background row z (``background`` is small and broadcast; pass a bounded
    table); for every feature j two variants differing only in j are scored:
    features ranked before j (and j itself in the "+" variant) come from x,
    the rest from z.  phi_j = mean over m of f(x+) - f(x-).
    ``keys`` must identify a row.
    """
    feats = list(scorer.features)
    p = len(feats)
    bg = background.select(*[c(f).cast("double").alias(f"__z{i}") for i, f in enumerate(feats)])
    bg = bg.withColumn("__bi", F.row_number().over(Window.orderBy(*[f"__z{i}" for i in range(p)])) - 1)  # small
    nb = bg.count()
    if nb > 100_000:
        raise ValueError(f"background has {nb} rows; pass a bounded sample (it is broadcast)")
    rows = df.select(F.struct(*[c(k) for k in keys]).alias("__key"), *[c(f).cast("double").alias(f) for f in feats])
    ex = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("__m"))
    hkey = F.xxhash64(F.to_json("__key"), F.col("__m"), F.lit(seed))
    ex = ex.withColumn("__bi", F.pmod(hkey, F.lit(nb)))
    ex = ex.join(F.broadcast(bg), "__bi")
    # rank of each feature in this sample's permutation
    hs = [F.xxhash64(hkey, F.lit(i)) for i in range(p)]
    for i in range(p):
        ex = ex.withColumn(f"__r{i}", sum((F.when(hs[k] < hs[i], 1).otherwise(0) for k in range(p)), F.lit(0)))
    var = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j in range(p) for s in (0, 1)]))
    ex = ex.select("*", var.alias("__v")).select("*", F.col("__v.j").alias("__j"), F.col("__v.s").alias("__s"))
    for i, f in enumerate(feats):
        from_x = (F.col(f"__r{i}") < F.element_at(F.array(*[F.col(f"__r{k}") for k in range(p)]), F.col("__j") + 1)) \
            | ((F.lit(i) == F.col("__j")) & (F.col("__s") == 1))
        ex = ex.withColumn(f, F.when(from_x, c(f)).otherwise(F.col(f"__z{i}")))
    sc = scorer(ex)
    phi = sc.groupBy("__key", "__j").agg(
        ((F.sum(F.when(F.col("__s") == 1, F.col("prediction")))
          - F.sum(F.when(F.col("__s") == 0, F.col("prediction")))) / F.lit(float(n_perm))).alias("shap"))
    names = F.array(*[F.lit(f) for f in feats])
    return phi.select("__key.*", F.element_at(names, F.col("__j") + 1).alias("feature"), "shap")


# ------------------------------------------------------------------ X8 local surrogate

def local_surrogate(df: DataFrame, scorer: Scorer, keys, n_samples: int = 200, top: int = 10,
                    seed: int = 42) -> DataFrame:
    """X8 (LIME-style): per row, ``n_samples`` Gaussian perturbations (feature std), scored together;
    exponential kernel on the standardised distance (width 0.75 sqrt(p)); per-row weighted least
    squares from the samples' normal equations, summed by a hash aggregate and solved in batches; top |coef|."""
    feats = list(scorer.features)
    p = len(feats)
    sd = df.agg(*[F.stddev_pop(c(f)).alias(f) for f in feats]).first()
    sds = [float(sd[f] or 1.0) or 1.0 for f in feats]
    rows = dealt_out(df.select(F.to_json(F.struct(*[c(k) for k in keys])).alias("__key"),
                               *[c(f).cast("double").alias(f) for f in feats]), 100)
    ex = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("__s"))
    for i, f in enumerate(feats):
        u1 = hash_uniform(["__key", "__s", F.lit(f"a{i}")], seed)
        u2 = hash_uniform(["__key", "__s", F.lit(f"b{i}")], seed)
        z = F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * np.pi * u2)   # Box-Muller
        ex = ex.withColumn(f"__z{i}", F.when(F.col("__s") == 0, F.lit(0.0)).otherwise(z)) \
            .withColumn(f, c(f) + F.col(f"__z{i}") * F.lit(sds[i]))
    sc = scorer(ex)
    width = 0.75 * math.sqrt(p)
    # the normal equations of every row, in one hash aggregate; a missing score leaves the row without weights
    one = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(p)]]
    y = F.coalesce(F.col("prediction").cast("double"), F.lit(float("nan")))
    sc = sc.withColumn("__w", F.exp(-sum((z * z for z in one[2:]), one[1] * one[1]) / F.lit(width ** 2)))
    pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
    sums = sc.groupBy("__key").agg(*[F.sum(F.col("__w") * one[i] * one[j]).alias(f"__g{k}") for k, (i, j) in enumerate(pairs)],
                                   *[F.sum(F.col("__w") * one[i] * y).alias(f"__r{i}") for i in range(p + 1)])
    row, column = np.array(pairs).T

    def fit(batches):
        for b in batches:
            n = b.num_rows
            value = [b.column(1 + k).to_numpy() for k in range(b.num_columns - 1)]
            G = np.empty((n, p + 1, p + 1))
            for k in range(len(pairs)):
                G[:, row[k], column[k]] = G[:, column[k], row[k]] = value[k]
            r = np.stack(value[len(pairs):], 1)[..., None] if n else np.zeros((0, p + 1, 1))
            coef = (np.linalg.pinv(G, 1e-12, hermitian=True) @ r)[:, 1:, 0] if n else np.zeros((0, p))
            order = np.argsort(-np.abs(coef), axis=1, kind="stable")[:, :top]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(n), order.shape[1]))), pa.array(np.array(feats, object)[order.ravel()], pa.string()),
                 pa.array(weight := np.take_along_axis(coef, order, 1).ravel(), pa.float64(), mask=np.isnan(weight))], names=["key", "feature", "weight"])
    return sums.mapInArrow(fit, "key string, feature string, weight double")


# ------------------------------------------------------------------ X14 / X15 curves

def learning_curve(prep, key: str, sizes=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 3, params=None,
                   seed: int = 42, metric: str | None = None):
    """Mean train / CV score for growing hash-prefix train subsets, k hash folds."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from tabsmith.functions.columns import hash_bucket
    from tabsmith.operators import cells
    from tabsmith.operators.estimators import make_estimator
    from tabsmith.plans.train import TASK_OF
    task = TASK_OF[key]
    ev = RegressionEvaluator(metricName=metric or "r2") if task == "regression" else \
        MulticlassClassificationEvaluator(metricName=metric or "accuracy")
    d = prep.data.withColumn("__fold", hash_bucket(prep.keys, seed + 1, folds)) \
        .withColumn("__u", hash_bucket(prep.keys, seed + 2, 10000) / 10000.0)
    spark, tree, schema = prep.data.sparkSession, make_estimator(key, params or {}), "train_fraction double, n_train long, train_score double, cv_score double"
    if isinstance(tree, cells.Tree) and metric is None and list(sizes) == sorted(sizes):
        first = sum(((F.col("__u") >= s).cast("int") for s in sizes), F.lit(0))
        got = cells.curve(d.withColumn("__fold", F.col("__fold").cast("int")).withColumn("__size", first), "__fold", folds, "__size", len(sizes), tree)
        if got:
            return spark.createDataFrame([(float(s), *(float(np.mean(v)) if k else int(np.mean(v)) for k, v in enumerate(zip(*scores, strict=True))))
                                          for s, scores in zip(sizes, got, strict=True)], schema)
    d = d.persist()
    out = []
    for size in sizes:
        tr_s, cv_s, n_tr = [], [], []
        for f in range(folds):
            tr = d.where((F.col("__fold") != f) & (F.col("__u") < size))
            te = d.where(F.col("__fold") == f)
            m = make_estimator(key, params or {}).fit(tr)
            tr_s.append(ev.evaluate(m.transform(tr)))
            cv_s.append(ev.evaluate(m.transform(te)))
            n_tr.append(tr.count())
        out.append((float(size), int(np.mean(n_tr)), float(np.mean(tr_s)), float(np.mean(cv_s))))
    d.unpersist()
    return spark.createDataFrame(out, schema)


def validation_curve(prep, key: str, param: str, value, folds: int = 3, seed: int = 42):
    """CV score at {max(1, v/2), v, 2v} of one hyper-parameter (hash folds)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from tabsmith.operators import cells
    from tabsmith.operators.estimators import make_estimator
    from tabsmith.plans.train import TASK_OF
    from tabsmith.functions.columns import hash_bucket
    task = TASK_OF[key]
    ev = RegressionEvaluator(metricName="r2") if task == "regression" else \
        MulticlassClassificationEvaluator(metricName="accuracy")
    isint = isinstance(value, int)
    vals = sorted({max(1, value // 2) if isint else value / 2, value, value * 2})
    d = prep.data.withColumn("__fold", hash_bucket(prep.keys, seed + 1, folds)).persist()
    estimators = [make_estimator(key, {param: v}) for v in vals]
    # the rows of a fold are binned once for all trees
    got = cells.search(d, "__fold", folds, estimators) if all(isinstance(e, cells.Tree) for e in estimators) else None
    out = []
    for i, v in enumerate(vals):
        scores = got[i] if got else []
        for f in range(folds if got is None else 0):
            m = estimators[i].fit(d.where(F.col("__fold") != f))
            scores.append(ev.evaluate(m.transform(d.where(F.col("__fold") == f))))
        out.append((param, float(v), float(np.mean(scores))))
    d.unpersist()
    return prep.data.sparkSession.createDataFrame(out, "param string, value double, cv_score double")


def prediction_candidates(pred: DataFrame, keys, min_conf: float = 0.0, limit: int = 50,
                          probability: str = "probability") -> DataFrame:
    """rows whose max class probability >= min_conf, first ``limit`` by key (regression: no filter)."""
    from pyspark.ml.functions import vector_to_array
    if probability in pred.columns:
        conf = F.array_max(vector_to_array(probability))
        pred = pred.withColumn("confidence", conf).where(F.col("confidence") >= min_conf)
    return pred.orderBy(*[c(k) for k in keys]).limit(limit)
