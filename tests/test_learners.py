"""Extra trees, nearest neighbours, DBSCAN, spectral clustering and boosting against plain versions."""
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.functions.partials import collected, fold, matrix
from tabsmith.operators import boosting, density, forest, neighbours, spectral


def frame(spark, x, y=None, parts=5):
    rows = [(i, [float(v) for v in r], None if y is None else float(y[i])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(parts)
    return df.withColumn("features", array_to_vector("x"))


def blobs(seed=1, n=120):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [5, 5], [0, 6]])
    x = np.concatenate([c + rng.normal(0, 0.6, (n, 2)) for c in centres] + [rng.uniform(-8, 14, (20, 2))])
    return np.round(x, 3), np.repeat([0, 1, 2, -1], [n, n, n, 20])


def test_fold_sums_and_minima(spark):
    df = spark.range(1000).repartition(7)

    def partial(batches):
        total, least = np.zeros(3), np.full(1, np.inf)
        for b in batches:
            v = b.column(0).to_numpy()
            total += [v.sum(), (v * v).sum(), len(v)]
            least = np.minimum(least, v.min()) if len(v) else least
        yield 0, total
        yield 1, least

    got = collected(fold(df, partial, {1: np.minimum}))
    assert got[0].tolist() == [499500, sum(i * i for i in range(1000)), 1000] and got[1].tolist() == [0]
    assert matrix(df.select(F.array("id", "id").alias("x")).toArrow()["x"]).shape == (1000, 2)


# ---------------------------------------------------------------- extra trees

def grow_plain(x, y, tree, trees, seed, classes, tries, least):
    """One tree by recursion over its rows, with the forest's keys and cuts; nodes as (feature, cut, value, left, right)."""
    f = forest.Forest(trees, seed)

    def node(rows, key, depth):
        stats = forest.label_stats(y[rows], classes)
        total = stats.sum(0)[None]
        value = (total[0] / total[0].sum()) if classes else np.array([total[0, 1] / total[0, 0]])
        lo, hi = x[rows].min(0)[None], x[rows].max(0)[None]
        feature, cut = forest.candidates(np.array([key], np.uint64), lo, hi, tries)
        small = (total[0].sum() if classes else total[0, 0]) < 2 * least
        if forest.pure(total, classes)[0] or small or depth >= forest.DEPTH:
            return (-1, 0.0, value, None, None)
        left = np.stack([stats[x[rows, k] <= c].sum(0) if k >= 0 else np.zeros(stats.shape[1]) for k, c in zip(feature[0], cut[0])])[None]
        pick, _ = forest.best_cuts(total, left, feature, classes, least)
        if pick[0] < 0:
            return (-1, 0.0, value, None, None)
        k, c = feature[0, pick[0]], cut[0, pick[0]]
        with np.errstate(over="ignore"):
            keys = forest._mix(np.array([key, key], np.uint64) * np.uint64(2) + np.array([0, 1], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        go = x[rows, k] <= c
        return (int(k), float(c), value, node(rows[go], keys[0], depth + 1), node(rows[~go], keys[1], depth + 1))

    return node(np.arange(len(x)), f.key[tree], 0)


def same_tree(model, at, want):
    feature, cut, value, left, right = want
    assert model.feature[at] == feature
    assert np.allclose(model.value[at], value)
    if feature >= 0:
        assert model.cut[at] == cut
        same_tree(model, model.left[at], left)
        same_tree(model, model.left[at] + 1, right)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_trees_equal_a_plain_grower(spark, task):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:, 3] = 1.0                                              # a constant feature
    x[:40] = x[0]                                              # repeated rows
    y = (x[:, 0] + x[:, 1] > 0).astype(float) + (x[:, 2] > 1) if task == "classification" else np.round(3 * x[:, 0] - x[:, 1], 2)
    model = forest.ExtraTrees(task=task, n_estimators=6, seed=11).fit(frame(spark, x, y))
    classes = 3 if task == "classification" else 0
    for tree in range(6):
        want = grow_plain(x, y, tree, 6, 11, classes, 2 if classes else 4, 1)
        same_tree(model, tree, want)
    scored = model.transform(frame(spark, x, y)).select("label", "prediction").collect()
    if classes:
        assert np.mean([r[0] == r[1] for r in scored]) > 0.9
    else:
        assert np.mean([(r[0] - r[1]) ** 2 for r in scored]) < 0.1 * np.var(y)
    assert math.isclose(model.featureImportances.toArray().sum(), 1) and model.featureImportances[3] == 0


def test_forest_does_not_depend_on_partitions_and_survives_saving(spark, tmp_path):
    x, y = blobs()
    y = np.maximum(y, 0)
    a = forest.ExtraTrees(n_estimators=20).fit(frame(spark, x, y, 1))
    b = forest.ExtraTrees(n_estimators=20).fit(frame(spark, x, y, 6))
    assert (a.feature == b.feature).all() and np.array_equal(a.cut, b.cut)
    a.write().overwrite().save(str(tmp_path / "forest"))
    back = forest._ForestModel.load(str(tmp_path / "forest"))
    df = frame(spark, x, y)
    assert [r["prediction"] for r in a.transform(df).orderBy("id").collect()] == [r["prediction"] for r in back.transform(df).orderBy("id").collect()]


def test_forest_of_one_class_and_one_row(spark):
    for y in (np.zeros(1), np.ones(1)):
        model = forest.ExtraTrees(n_estimators=3).fit(frame(spark, np.ones((1, 2)), y))
        assert model.transform(frame(spark, np.ones((1, 2)), y)).first()["prediction"] == y[0]


# ---------------------------------------------------------------- neighbours

def near_plain(x, keys, q, k):
    out = []
    for v in q:
        d = np.zeros(len(x))
        for f in range(x.shape[1]):
            d += (v[f] - x[:, f]) ** 2
        order = np.lexsort((keys, d))[:k]
        out.append([(float(d[i]), int(keys[i])) for i in order])
    return out


@pytest.mark.parametrize(("width", "leaf"), [(2, 16), (6, 40)])
def test_neighbours_equal_brute_force(spark, width, leaf):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(700, width)), 1 if width == 2 else 3)
    x[:230] = x[0]                                             # a third of the rows is one point
    q = np.concatenate([x[::9], rng.normal(size=(30, width)) * 3])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, x array<double>").repartition(4)
    rows = rows.unionByName(spark.createDataFrame([(9000, [float("nan")] * width), (9001, None)], "key long, x array<double>"))
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "qid long, x array<double>")
    got = neighbours.nearest(asked, neighbours.build(rows, 7, leaf_rows=leaf), 7).collect()
    by = {}
    for r in got:
        by.setdefault(r["qid"], []).append((r["d2"], r["key"]))
    want = near_plain(x, np.arange(len(x)), q, 7)
    assert [sorted(by[i]) for i in range(len(q))] == want


@pytest.mark.parametrize("shift", [0.0, 1e8, 1e200])
def test_visit_of_a_leaf_equals_brute_force(shift, monkeypatch):
    """All queries of a leaf at once: far from zero, with ties, limits and several keys of a point."""
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rng = np.random.default_rng(3)
    p = np.round(rng.normal(size=(300, 3)) * 3) + shift
    p = np.unique(p * (1 + rng.integers(0, 2, p.shape)) if shift == 1e200 else p, axis=0)
    lists = [sorted(rng.integers(0, 9, rng.integers(1, 5)).tolist()) for _ in p]
    q = np.concatenate([p[::3], np.round(rng.normal(size=(40, 3)) * 4, 1) + shift])
    limit = np.where(np.arange(len(q)) % 4 == 0, 2.0, np.inf)
    got = list(zip(*(v.tolist() for v in neighbours._top(p, pa.array(lists), q, limit, 5)), strict=True))
    flat, keys = np.repeat(p, [len(v) for v in lists], axis=0), np.concatenate(lists)
    with np.errstate(over="ignore"):
        want = [(i, d, key) for i, best in enumerate(near_plain(flat, keys, q, 5)) for d, key in best if d <= limit[i]]
    assert got == want


def test_home_leaf_answers_a_query_in_one_row(spark):
    """Queries go through no second shuffle after their home leaf; queries of a leaf without points are kept."""
    rows = spark.createDataFrame([(i, [float(i % 40)]) for i in range(400)], "key long, x array<double>")
    index = neighbours.build(rows, 3, leaf_rows=8)
    asked = spark.createDataFrame([(i, [i / 2]) for i in range(90)], "qid long, x array<double>")
    home = neighbours._leafed(asked, index.tree)
    got = {r["qid"]: r for r in neighbours._at_home(index.points.filter("leaf <> 0"), home, 3).collect()}
    assert len(got) == 90 and all(len(r["ds"]) == len(r["keys"]) == (3 if r["leaf"] else 0) for r in got.values())
    assert all(r["d2"] == (r["ds"][-1] if r["leaf"] else math.inf) for r in got.values())


def test_feature_elimination_fits_on_distinct_rows(spark, monkeypatch):
    """Once the only continuous feature is dropped, the fits read the distinct rows with their counts, and choose the same."""
    from tabsmith.operators import estimators
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 4, 4000), rng.integers(0, 3, 4000), rng.integers(0, 2, 4000)
    y = (a + rng.normal(size=4000) > 1.5 + 0.5 * b).astype(int)
    df = spark.createDataFrame([(float(v) * 1e4, int(i), int(j), int(k), int(t)) for v, i, j, k, t in zip(rng.normal(size=4000), a, b, c, y, strict=True)],
                               "wide double, a int, b int, c int, y int")
    seen = []

    class Seen(estimators.LogisticRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    whole = [tuple(r) for r in estimators.rfe_ranking(df, ["wide", "a", "b", "c"], "y", 2, "classification").collect()]
    monkeypatch.setattr(estimators, "RFE_ROWS", 1000)
    monkeypatch.setattr(estimators, "LogisticRegression", Seen)
    assert [tuple(r) for r in estimators.rfe_ranking(df, ["wide", "a", "b", "c"], "y", 2, "classification").collect()] == whole
    assert seen[0] == 4000 and seen[1] <= 4 * 3 * 2 * 2 and [r[3] for r in whole] == [False, True, True, False]


def test_fewer_rows_than_k_and_empty(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "key long, x array<double>")
    asked = spark.createDataFrame([(0, [1.0])], "qid long, x array<double>")
    got = neighbours.nearest(asked, neighbours.build(rows, 5), 5).collect()
    assert sorted((r["key"], r["d2"]) for r in got) == [(1, 1.0), (2, 4.0)]
    assert neighbours.nearest(asked, neighbours.build(rows.limit(0), 5), 5).count() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_k_nearest_model(spark, task, tmp_path):
    x, y = blobs()
    y = np.maximum(y, 0) if task == "classification" else x[:, 0] * 2
    df = frame(spark, x, y)
    model = neighbours.KNearest(task=task, k=5).fit(df)
    odd = spark.createDataFrame([(999, [float("nan"), 0.0], 0.0)], "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    rows = model.transform(df.unionByName(odd)).collect()
    assert len(rows) == len(x) + 1 and [r["prediction"] for r in rows if r["id"] == 999] == [None]
    for r in rows:
        if r["id"] % 10 or r["id"] == 999:
            continue
        d = ((x - np.array(r["x"])) ** 2).sum(1)
        labels = y[np.lexsort((y, np.round(d, 12)))[:5]]
        if task == "classification":
            votes = np.bincount(labels.astype(int), minlength=3)
            assert r["prediction"] == votes.argmax() and np.allclose(r["probability"].toArray(), votes / 5)
        else:
            assert math.isclose(r["prediction"], labels.mean())
    model.write().overwrite().save(str(tmp_path / task))
    back = neighbours._KNearestModel.load(str(tmp_path / task))
    assert {(r["id"], r["prediction"]) for r in back.transform(df).collect()} == {(r["id"], r["prediction"]) for r in rows if r["id"] != 999}


# ---------------------------------------------------------------- DBSCAN

def dbscan_plain(x, eps, least):
    pts = sorted({tuple(r) for r in x})
    weight = {p: 0 for p in pts}
    for r in x:
        weight[tuple(r)] += 1
    def d2(p, q):
        return sum((a - b) * (a - b) for a, b in zip(p, q))
    near = {p: [q for q in pts if d2(p, q) <= eps * eps] for p in pts}
    core = [p for p in pts if sum(weight[q] for q in near[p]) >= least]
    label, n = {}, 0
    for p in core:                       # ascending, so clusters are numbered by their least core point
        if p in label:
            continue
        todo = [p]
        while todo:
            q = todo.pop()
            if q in label:
                continue
            label[q] = n
            todo += [r for r in near[q] if r in set(core)]
        n += 1
    out = {}
    cores = set(core)
    for p in pts:
        if p in cores:
            out[p] = label[p]
        else:
            best = min(((d2(p, q), q) for q in near[p] if q in cores), default=None)
            out[p] = -1 if best is None else label[best[1]]
    return out


@pytest.mark.parametrize(("eps", "least", "width"), [(0.5, 5, 2), (0.9, 4, 5)])
def test_dbscan_equals_brute_force(spark, eps, least, width):
    x, _ = blobs(n=90)
    rng = np.random.default_rng(2)
    x = x[:, :1] if width == 1 else x if width == 2 else np.round(np.concatenate([x, rng.normal(0, 0.2, (len(x), 3))], 1), 3)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])       # a hot point
    got = density.clusters(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5), eps, least)
    assert {tuple(r["x"]): r["cluster"] for r in got.collect()} == dbscan_plain(x, eps, least)


def test_dbscan_chunks_and_unlinked_dense_cells(spark, monkeypatch):
    monkeypatch.setattr(density, "CHUNK", 16)
    rng = np.random.default_rng(4)
    # two dense strips 0.49 apart in places only, so that the nearest points of neighbouring cells do not always link
    a = np.stack([rng.uniform(0, 3, 200), rng.uniform(0, 0.3, 200)], 1)
    b = np.stack([rng.uniform(0, 3, 200), rng.uniform(0.75, 1.0, 200)], 1)
    x = np.round(np.concatenate([a, b]), 3)
    got = density.clusters(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), 0.5, 4)
    assert {tuple(r["x"]): r["cluster"] for r in got.collect()} == dbscan_plain(x, 0.5, 4)


def test_dbscan_odd_rows(spark):
    df = spark.createDataFrame([([float("nan"), 1.0],), (None,), ([1.0, 1.0],)], "x array<double>")
    got = density.clusters(df, 0.5, 1).collect()
    assert [(r["x"], r["cluster"]) for r in got] == [([1.0, 1.0], 0)]
    x, _ = blobs()
    out = density.DBSCAN(eps=0.8).fit(frame(spark, x)).transform(frame(spark, x))
    assert out.count() == len(x) and out.filter("cluster >= 0").select("cluster").distinct().count() == 3


# ---------------------------------------------------------------- spectral

def test_spectral_finds_blobs(spark, tmp_path):
    x, y = blobs()
    keep = y >= 0
    df = frame(spark, x[keep], y[keep])
    model = spectral.Spectral(k=3, gamma=1.0, landmarks=60).fit(df)
    rows = model.transform(df).collect()
    assert len(rows) == keep.sum()
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], set()).add(r["label"])
    assert len(by) == 3 and all(len(v) == 1 for v in by.values())
    # with every row a landmark the vectors are those of the exact normalised affinity
    exact = spectral.Spectral(k=3, landmarks=1000).fit(df)
    a = spectral.affinity(x[keep], x[keep], 1.0)
    d = a.sum(1)
    values, vectors = np.linalg.eigh(a / np.sqrt(d[:, None] * d[None]))
    lead = vectors[:, ::-1][:, :3]
    lead = lead / np.linalg.norm(lead, axis=1, keepdims=True)
    mine = exact.vectors(x[keep])
    assert np.allclose(lead @ lead.T, mine @ mine.T, atol=1e-3)
    model.write().overwrite().save(str(tmp_path / "s"))
    back = spectral._SpectralModel.load(str(tmp_path / "s"))
    assert [r["cluster"] for r in back.transform(df).orderBy("id").collect()] == [r["cluster"] for r in model.transform(df).orderBy("id").collect()]


# ---------------------------------------------------------------- boosting

def plain_rounds_clf(codes, y, rounds, lr, classes):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        hist = np.zeros((codes.shape[1], boosting.BINS, classes))
        for f in range(codes.shape[1]):
            np.add.at(hist[f], (codes[:, f], y), w)
        stump, last = boosting.best_stump(hist, lr)
        out.append(stump)
        f, b, left, right, a = stump
        w = w * np.exp(a * (np.where(codes[:, f] <= b, left, right) != y))
        if last:
            break
    return out


def test_adaboost_classifier_rounds(spark, tmp_path):
    x, y = blobs()
    y = np.maximum(y, 0)
    df = frame(spark, x, y)
    model = boosting.AdaBoostClassifier(n_estimators=30, learning_rate=0.3).fit(df)      # crosses a rebase
    want = plain_rounds_clf(boosting.bins_of(x, model.cuts), y, 30, 0.3, 3)
    assert len(model.stumps) == 30
    assert np.allclose(model.stumps, np.array(want, float), atol=1e-9)
    acc = np.mean([r["label"] == r["prediction"] for r in model.transform(df).collect()])
    assert acc > 0.9
    model.write().overwrite().save(str(tmp_path / "ada"))
    assert np.allclose(boosting._StumpsModel.load(str(tmp_path / "ada")).votes(x), model.votes(x))


def test_adaboost_regressor_rounds(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(0, 10, (250, 3)), 2)
    y = np.round(np.sin(x[:, 0]) * 5 + x[:, 1], 3)
    df = frame(spark, x, y)
    model = boosting.AdaBoostRegressor(n_estimators=8, learning_rate=0.5).fit(df)
    codes = boosting.bins_of(x, model.cuts)
    w = np.ones(len(y))
    for t in range(len(model.weight)):
        tree = (np.zeros(0, int), np.zeros(0, int), None)
        for depth in range(boosting.DEPTH):
            hist = np.zeros((2, 1 << depth, 3, boosting.BINS))
            node = boosting.tree_leaf(codes, tree, depth)
            for f in range(3):
                np.add.at(hist[0][:, f], (node, codes[:, f]), w)
                np.add.at(hist[1][:, f], (node, codes[:, f]), w * y)
            feature, cut, value = boosting.best_level(hist)
            tree = (np.concatenate([tree[0], feature]), np.concatenate([tree[1], cut]), value)
        assert (model.feature[t] == tree[0]).all() and (model.cut[t] == tree[1]).all() and np.allclose(model.value[t], tree[2])
        e = np.abs(boosting.tree_values(codes, tree) - y)
        loss = (w @ e) / w.sum() / e.max()
        beta = loss / (1 - loss)
        assert math.isclose(model.weight[t], -0.5 * math.log(beta), rel_tol=1e-9)
        w = w * beta ** (0.5 * (1 - e / e.max()))
    pred = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    # weighted median, straight
    values = np.stack([boosting.tree_values(codes, t) for t in zip(model.feature, model.cut, model.value)], 1)
    for i in range(0, 250, 25):
        order = np.argsort(values[i], kind="stable")
        at = np.searchsorted(np.cumsum(model.weight[order]), 0.5 * model.weight.sum())
        assert pred[i] == values[i][order[at]]
    assert np.mean([(pred[i] - y[i]) ** 2 for i in range(250)]) < 0.4 * np.var(y)


@pytest.mark.parametrize("kind", [boosting.AdaBoostClassifier, boosting.AdaBoostRegressor])
def test_one_task_boosts_as_many_do(spark, monkeypatch, kind):
    x, y = blobs(4)
    df = frame(spark, x, np.maximum(y, 0), 1)
    monkeypatch.setattr(boosting, "labelled", lambda df, *a, made=boosting.labelled: made(df, *a).coalesce(1))
    models = []
    for most in (16, 0):
        monkeypatch.setattr(boosting, "PACKS_ALONE", most)
        models.append(kind(n_estimators=30, learning_rate=0.3).fit(df))       # crosses a rebase
    for field in models[0]._fields[:4] if kind is boosting.AdaBoostRegressor else ("stumps",):
        assert np.allclose(getattr(models[0], field), getattr(models[1], field), rtol=1e-9) and len(getattr(models[0], field))


def test_boosting_on_constant_features(spark):
    x = np.ones((10, 2))
    y = np.array([0.0] * 7 + [1.0] * 3)
    model = boosting.AdaBoostClassifier(n_estimators=5).fit(frame(spark, x, y))
    assert {r["prediction"] for r in model.transform(frame(spark, x, y)).collect()} == {0.0}
    flat = boosting.AdaBoostRegressor(n_estimators=5).fit(frame(spark, x, np.full(10, 2.0)))
    assert {r["prediction"] for r in flat.transform(frame(spark, x, y)).collect()} == {2.0}
