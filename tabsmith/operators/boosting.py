"""Boosting without a tree fit per round.

The features are binned once; the rows kept are a byte per feature, the label and the state of the boosting (a log
weight), thousands of rows to a record, so that a pass over them is NumPy's and not the conversion of rows.  A round is one weighted histogram over (node, feature, bin) a level, folded on Spark, from which the driver
reads all cuts of all features at once.  A row's weight is an expression of the learners chosen so far, evaluated
in NumPy inside the histogram pass; every ``REBASE`` rounds it is written into the kept rows, so no lineage and no
expression grows with the number of rounds.  A small table, of one partition, goes through the same rounds inside one task.  Scoring evaluates all learners in one pass over arrays.

Bins: at most ``BINS`` per feature, cut halfway between its percentiles; the same bound as Spark ML's trees.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, fold, matrix
from tabsmith.functions.storage import Stored

BINS = 32
REBASE = 25
ROWS = 1 << 14
#: Packs of a table that one task boosts by itself.
PACKS_ALONE = 16


def cut_points(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending cuts per element of the array column ``x``; a value is in the bin of the first cut that is not below it.

    Cuts lie halfway between neighbouring values of a bounded list: ``BINS`` percentiles from the least to the greatest.
    """
    if not width:
        return []
    probs = [k / (BINS - 1) for k in range(BINS)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"q{i}") for i in range(width)]).first()
    out = []
    for i in range(width):
        values = np.unique(np.array(got[f"q{i}"] or [], float))
        out.append(values[:-1] + (values[1:] - values[:-1]) / 2)
    return out


def labelled(df: DataFrame, features: str, label: str) -> DataFrame:
    """(x array, y) of every row with a label."""
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.filter("y is not null and not isnan(y)")


def binned(rows: DataFrame, packs: bool) -> tuple[DataFrame, list[np.ndarray]]:
    """(bins binary, y, logw) of every labelled row, or of packs of rows, and the cuts; a missing feature is in the first bin."""
    width = (rows.agg(F.max(F.size("x"))).first()[0]) or 0
    cuts = cut_points(rows, width)

    def run(batches):
        for b in batches:
            codes, y = bins_of(matrix(b.column(0)), cuts) if b.num_rows else np.zeros((0, width), np.uint8), b.column(1).to_numpy()
            if packs:
                yield from _pack(codes, y, np.zeros(len(y)))
                continue
            at = (np.arange(len(y) + 1) * width).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([data, b.column(1), pa.array(np.zeros(len(y)))], names=["bins", "y", "logw"])

    return rows.mapInArrow(run, PACKS if packs else "bins binary, y double, logw double"), cuts


#: Rows of one batch travel as one row of arrays: the codes feature by feature, the labels, the log weights.
PACKS = "bins binary, y binary, logw binary"


def _pack(codes: np.ndarray, y: np.ndarray, logw: np.ndarray):
    for s in range(0, len(y), ROWS):
        part = slice(s, s + ROWS)
        data = [np.ascontiguousarray(codes[part].T).tobytes(), y[part].astype(float).tobytes(), logw[part].astype(float).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["bins", "y", "logw"])


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Packs of the rows (bins, y, logw)."""
    def run(batches):
        for b in batches:
            yield from _pack(_codes(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy())

    return rows.mapInArrow(run, PACKS)


def _unpacked(batches, width: int):
    """(codes, y, log weight) of every pack; the codes lie feature by feature."""
    for b in batches:
        for bins, y, logw in zip(*b.columns, strict=True):
            y = np.frombuffer(y.as_buffer(), float)
            yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, len(y)).T, y, np.frombuffer(logw.as_buffer(), float)


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(x), len(cuts)), np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, np.nan_to_num(x[:, i], nan=-np.inf), side="left")
    return out


def _codes(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]].reshape(len(column), width)


def _rows(batches, width: int, state):
    """(codes, y, log weight now): the kept log weight plus what ``state`` adds."""
    for codes, y, logw in _unpacked(batches, width):
        yield codes, y, logw + state(codes, y)


class _Boosted(Estimator):
    """The loop: histograms, learners, and the kept rows' state."""

    def __init__(self, featuresCol, labelCol, n_estimators, learning_rate):
        super().__init__()
        self.fc, self.lc, self.rounds, self.lr = featuresCol, labelCol, n_estimators, learning_rate

    def _fit(self, df):
        rows, cuts = self._kept(labelled(df, self.fc, self.lc))
        self.width = len(cuts)
        rows = rows.persist()
        self.alone = rows.rdd.getNumPartitions() == 1      # a small table: its one task has all sums
        if self.alone and rows.count() <= PACKS_ALONE:
            def whole(batches):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(self._learned([*batches], lambda kept, moved: [*moved(kept)]))], pa.binary())], names=["learners"])

            learners = pickle.loads(rows.mapInArrow(whole, "learners binary").first()[0])
        else:
            held = [rows]

            def moved_to(kept, moved):
                after = kept.mapInArrow(moved, PACKS).persist()
                after.count()                  # computed before what it comes from is let go
                kept.unpersist()
                held[0] = after
                return after

            learners = self._learned(rows, moved_to)
            rows = held[0]
        rows.unpersist()
        return self._model(learners, cuts)

    def _learned(self, rows, moved_to) -> list:
        """The learners of all rounds; ``rows`` is a DataFrame or, in a task, its batches, and ``moved_to`` gives the rows that a function of batches makes."""
        since: list = []                       # learners whose weights are not in the kept rows yet
        learners: list = []
        while len(learners) < self.rounds:
            got = self._round(rows, self._state(since))
            if got is None:
                break
            learner, last = got
            learners.append(learner)
            since.append(learner)
            if last:
                break
            if len(since) == REBASE:
                state = self._state(since)
                width = self.width

                def moved(batches, state=state, width=width):
                    for codes, y, logw in _rows(batches, width, state):
                        yield from _pack(codes, y, logw)

                rows, since = moved_to(rows, moved), []
        return learners

    def _sums(self, rows, partial, add=np.add) -> dict[int, np.ndarray]:
        """The blocks of all rows on the driver, or in the task that has them all."""
        if isinstance(rows, list):
            return dict(partial(rows)) if rows else {}
        return collected(fold(rows, partial, add, parts=1, alone=self.alone))

    def _kept(self, rows: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
        """Packs of the labelled rows, and the cuts."""
        return binned(rows, True)


# ------------------------------------------------------------------ classification

def stump_votes(codes: np.ndarray, stumps: list) -> np.ndarray:
    """Class that every stump votes for, (stumps, rows)."""
    return np.stack([np.where(codes[:, f] <= b, left, right) for f, b, left, right, _ in stumps]) if stumps else np.zeros((0, len(codes)), int)


def stump_tables(stumps: list, classes: int) -> dict[int, np.ndarray]:
    """Per feature (bins, classes): the log weight that its stumps add to a row of that bin and class."""
    out: dict[int, np.ndarray] = {}
    for f, b, left, right, a in stumps:
        table = out.setdefault(f, np.zeros((BINS, classes)))
        table += a
        table[: b + 1, left] -= a
        table[b + 1:, right] -= a
    return out


class AdaBoostClassifier(_Boosted):
    """SAMME with stumps; a round is one histogram of class weights.

    Rows of one class whose features have the same bins keep the same weight in all rounds: they are one row from the
    start, whose weight is their number.
    """

    def __init__(self, featuresCol="features", labelCol="label", n_estimators=400, learning_rate=0.05):
        super().__init__(featuresCol, labelCol, n_estimators, learning_rate)

    def _kept(self, rows):
        self.classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
        rows, cuts = binned(rows, False)
        cells = rows.groupBy("bins", "y").agg(F.log(F.count(F.lit(1)).cast("double")).alias("logw"))
        return packed(cells, len(cuts)), cuts

    def _state(self, stumps):
        # what a bin of a feature adds for every class, over all stumps on the feature
        tables = stump_tables(stumps, self.classes)

        def added(codes, y):
            out = np.zeros(len(y))
            label = y.astype(int)
            for f, table in tables.items():
                out += table[codes[:, f], label]
            return out
        return added

    def _round(self, rows, state):
        width, classes = self.width, self.classes

        def partial(batches):
            out = np.zeros((width, BINS * classes))
            for codes, y, logw in _rows(batches, width, state):
                w, c = np.exp(logw), y.astype(int)
                for f in range(width):
                    out[f] += np.bincount(codes[:, f].astype(int) * classes + c, w, BINS * classes)
            yield 0, out.reshape(-1)

        got = self._sums(rows, partial)
        if not got or not width:
            return None
        return best_stump(got[0].reshape(width, BINS, classes), self.lr)

    def _model(self, learners, cuts):
        return _StumpsModel(np.array(learners, float).reshape(-1, 5), cuts, self.classes, self.fc)


def best_stump(hist: np.ndarray, lr: float) -> tuple[tuple, bool] | None:
    """((feature, bin, left class, right class, weight), whether boosting ends) from (features, bins, classes) weights.

    The cut of least gini impurity; of equal ones the first feature and bin.  None if it is no better than chance.
    """
    classes = hist.shape[2]
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist.sum(1)[:, None]
    right = total - left
    n_l, n_r = left.sum(2), right.sum(2)
    with np.errstate(invalid="ignore", divide="ignore"):
        purity = np.where((n_l > 0) & (n_r > 0), (left ** 2).sum(2) / n_l + (right ** 2).sum(2) / n_r, -np.inf)
    whole = total[0, 0].sum()
    purity = np.round(purity / whole, 12)
    if not np.isfinite(purity.max()):                  # nothing to cut
        f = b = 0
        l_class = r_class = int(total[0, 0].argmax())
        right_weight = total[0, 0].max()
    else:
        f, b = np.unravel_index(purity.argmax(), purity.shape)
        l_class, r_class = int(left[f, b].argmax()), int(right[f, b].argmax())
        right_weight = left[f, b].max() + right[f, b].max()
    err = 1 - right_weight / whole
    if err >= 1 - 1.0 / classes:
        return None
    err = max(err, 1e-10)
    a = lr * (np.log((1 - err) / err) + np.log(classes - 1))
    return (int(f), int(b), l_class, r_class, float(a)), err <= 1e-10


class _StumpsModel(Model, Stored):
    """Class with the greatest sum of stump weights; of equal sums the smallest."""

    _fields = ("stumps", "cuts", "classes", "fc")

    def __init__(self, stumps, cuts, classes, fc):
        super().__init__()
        self.stumps, self.cuts, self.classes, self.fc = np.asarray(stumps, float), [np.asarray(c, float) for c in cuts], classes, fc

    def votes(self, x: np.ndarray) -> np.ndarray:
        codes = bins_of(x, self.cuts)
        out = np.zeros((len(x), self.classes))
        at = np.arange(len(x))
        for f, b, left, right, a in self.stumps:
            out[at, np.where(codes[:, int(f)] <= b, left, right).astype(int)] += a
        return out

    def _transform(self, df):
        model = self

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(model.votes(matrix(x)).argmax(1).astype(float) if len(x) else np.zeros(0))

        return df.withColumn("prediction", predict(vector_to_array(F.col(self.fc))))


# ------------------------------------------------------------------ regression

DEPTH = 3


class AdaBoostRegressor(_Boosted):
    """A10: AdaBoost.R2 (linear loss) with trees of depth 3; a round is a histogram per level and one of errors."""

    def __init__(self, featuresCol="features", labelCol="label", n_estimators=300, learning_rate=0.05):
        super().__init__(featuresCol, labelCol, n_estimators, learning_rate)

    def _state(self, learners):
        learners = list(learners)
        lr = self.lr

        def added(codes, y):
            out = np.zeros(len(y))
            for tree, log_beta, most in learners:
                out += log_beta * lr * (1 - np.abs(tree_values(codes, tree) - y) / most)
            return out
        return added

    def _round(self, rows, state):
        width = self.width
        if not width:
            return None
        tree = [np.zeros(0, int), np.zeros(0, int), None]      # features, bins of a complete tree, leaf values
        for depth in range(DEPTH):
            size = 1 << depth
            sofar = (tree[0], tree[1])

            def partial(batches, size=size, depth=depth, sofar=sofar):
                out = np.zeros((2, size, width, BINS))
                for codes, y, logw in _rows(batches, width, state):
                    w = np.exp(logw)
                    node = tree_leaf(codes, sofar, depth)
                    for f in range(width):
                        cell = node * BINS + codes[:, f]
                        out[0, :, f] += np.bincount(cell, w, size * BINS).reshape(size, BINS)
                        out[1, :, f] += np.bincount(cell, w * y, size * BINS).reshape(size, BINS)
                yield 0, out.reshape(-1)

            got = self._sums(rows, partial)
            if not got:
                return None
            feature, cut, value = best_level(got[0].reshape(2, size, width, BINS))
            tree = [np.concatenate([tree[0], feature]), np.concatenate([tree[1], cut]), value]

        def errors(batches):
            w_e = w_all = most = 0.0
            for codes, y, logw in _rows(batches, width, state):
                e, w = np.abs(tree_values(codes, tree) - y), np.exp(logw)
                w_e, w_all, most = w_e + float(w @ e), w_all + float(w.sum()), max(most, float(e.max()))
            yield 0, np.array([w_e, w_all])
            yield 1, np.array([most])

        both = self._sums(rows, errors, {1: np.maximum})
        (w_e, w_all), most = both[0], float(both[1][0])
        if most <= 0:
            return (tree, float(np.log(1e-10)), 1.0), True
        loss = w_e / w_all / most
        if loss >= 0.5:
            return None
        beta = max(loss / (1 - loss), 1e-300)
        return (tree, float(np.log(beta)), most), False

    def _model(self, learners, cuts):
        trees = [t for t, _, _ in learners]
        return _TreesModel(np.array([t[0] for t in trees], int).reshape(-1, (1 << DEPTH) - 1), np.array([t[1] for t in trees], int).reshape(-1, (1 << DEPTH) - 1),
                           np.array([t[2] for t in trees], float).reshape(-1, 1 << DEPTH), np.array([-self.lr * b for _, b, _ in learners], float), cuts, self.fc)


def tree_leaf(codes: np.ndarray, tree, depth: int) -> np.ndarray:
    """Node of every row at ``depth`` of a complete tree whose nodes are listed level by level.

    Every cut is one comparison of a whole column; a row's turns are picked from its level's comparisons.
    """
    node = np.zeros(len(codes), np.uint8)
    for d in range(depth):
        first = (1 << d) - 1
        right = codes[:, tree[0][first]] > int(tree[1][first])
        for k in range(1, 1 << d):
            here = node == k
            right = (right & ~here) | ((codes[:, tree[0][first + k]] > int(tree[1][first + k])) & here)
        node = 2 * node + right
    return node


def tree_values(codes: np.ndarray, tree) -> np.ndarray:
    return np.take(tree[2], tree_leaf(codes, tree, DEPTH))


def best_level(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, values of both children) per node, by the variance left; hist is (weight or weighted label, node, feature, bin).

    A node that no cut divides sends all rows left; both children get its mean.
    """
    w, wy = np.cumsum(hist[0], 2), np.cumsum(hist[1], 2)
    total_w, total_y = w[..., -1:], wy[..., -1:]
    n_l, n_r = w[..., :-1], total_w - w[..., :-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.where((n_l > 0) & (n_r > 1e-12 * total_w), wy[..., :-1] ** 2 / n_l + (total_y - wy[..., :-1]) ** 2 / n_r, -np.inf)
    size, width, cuts = gain.shape
    flat = gain.reshape(size, -1)
    scale = np.maximum(np.abs(np.where(np.isfinite(flat), flat, 0)).max(1, keepdims=True), 1e-300)
    best = np.round(flat / scale, 12).argmax(1)
    ok = np.isfinite(flat[np.arange(size), best])
    feature, cut = np.where(ok, best // cuts, 0), np.where(ok, best % cuts, BINS)
    values = []
    for i in range(size):
        tw, ty = float(total_w[i, 0, 0]), float(total_y[i, 0, 0])
        mean = ty / tw if tw > 0 else 0.0
        if ok[i]:
            lw, ly = float(w[i, feature[i], cut[i]]), float(wy[i, feature[i], cut[i]])
            values += [ly / lw, (ty - ly) / (tw - lw)]
        else:
            values += [mean, mean]
    return feature, cut, np.array(values)


class _TreesModel(Model, Stored):
    """Weighted median of the trees' values."""

    _fields = ("feature", "cut", "value", "weight", "cuts", "fc")

    def __init__(self, feature, cut, value, weight, cuts, fc):
        super().__init__()
        self.feature, self.cut, self.value, self.weight = np.asarray(feature, int), np.asarray(cut, int), np.asarray(value, float), np.asarray(weight, float)
        self.cuts, self.fc = [np.asarray(c, float) for c in cuts], fc

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(x), np.nan)
        codes = bins_of(x, self.cuts)
        values = np.stack([tree_values(codes, t) for t in zip(self.feature, self.cut, self.value, strict=True)], 1)
        order = np.argsort(values, axis=1, kind="stable")
        reached = np.cumsum(self.weight[order], axis=1) >= 0.5 * self.weight.sum()
        return values[np.arange(len(x)), order[np.arange(len(x)), reached.argmax(1)]]

    def _transform(self, df):
        model = self

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            rows = matrix(x)
            return pa.array(np.concatenate([model.predict(rows[s: s + 4096]) for s in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0))

        return df.withColumn("prediction", predict(vector_to_array(F.col(self.fc))))
