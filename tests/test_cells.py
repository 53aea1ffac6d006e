"""Decision trees over cells against Spark ML's trees on the same rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabsmith.operators import cells, forest
from tabsmith.operators import explain as X
from tabsmith.operators.estimators import make_estimator
from tabsmith.plans import train as TR


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=3000), rng.integers(0, 6, 3000), rng.integers(0, 2, 3000)], 1)
    y = np.where(x[:, 0] > 0.3, 5.0, x[:, 1]) + rng.normal(size=3000)
    k = (y > 2).astype(int) + (y > 4)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, k))],
                               "id bigint, x array<double>, y double, k double")
    return df.select("id", array_to_vector("x").alias("features"), "y", "k").persist()


@pytest.mark.parametrize("task, label, depth, least, local", [
    ("regression", "y", 5, 15, 20), ("regression", "y", 5, 15, 10_000), ("classification", "k", 4, 20, 30), ("regression", "y", 0, 1, 10)])
def test_tree_of_cells_is_spark_mls(rows, task, label, depth, least, local):
    kind = DecisionTreeRegressor if task == "regression" else DecisionTreeClassifier
    plain = kind(featuresCol="features", labelCol=label, maxDepth=depth, minInstancesPerNode=least, seed=42).fit(rows)
    packed = cells.pack(rows, "features", label, task, small=0)
    assert packed.cells.count() < 400 and packed.cells.agg(F.sum("n")).first()[0] == 3000
    tree = cells.grow(packed, depth, least, "features", local)
    a = [r[0] for r in plain.transform(rows).orderBy("id").select("prediction").collect()]
    b = [r[0] for r in tree.transform(rows).orderBy("id").select("prediction").collect()]
    assert np.allclose(a, b, rtol=1e-9)
    assert np.allclose(plain.featureImportances.toArray(), tree.featureImportances.toArray(), atol=1e-9)


def test_thresholds_are_spark_mls(spark, rows):
    x = np.array([r[0][0] for r in rows.select("features").collect()])
    cut = cells.thresholds(x)
    assert len(cut) == 31
    shares = np.diff(np.concatenate([[0], np.searchsorted(np.sort(x), cut, side="right"), [len(x)]])) / len(x)
    assert np.abs(shares - 1 / 32).max() < 0.002
    assert cells.thresholds(np.array([1.0, 3.0, 1.0])).tolist() == [2.0] and not len(cells.thresholds(np.ones(5)))


@pytest.mark.parametrize("key, label", [("reg_decision_tree", "y"), ("clf_decision_tree", "k")])
def test_search_bins_a_fold_once(rows, monkeypatch, key, label):
    data = rows.select("features", F.col(label).alias("label"), (F.col("id") % 2).cast("int").alias("fold"))
    trees = [make_estimator(key, {"max_depth": d, "min_samples_leaf": 15}) for d in (1, 4)]
    monkeypatch.setattr(cells, "SMALL", 0)
    packs = []
    monkeypatch.setattr(cells, "_packed", lambda *a, made=cells._packed: packs.append(1) or made(*a))
    got = cells.search(data, "fold", 2, trees)
    assert len(packs) == 2
    good = (1 - F.avg((F.col("label") - F.col("prediction")) ** 2) / F.var_pop("label") if label == "y"
            else F.avg((F.col("label") == F.col("prediction")).cast("double")))
    want = [[t.plain.fit(data.where(f"fold <> {f}")).transform(data.where(f"fold = {f}")).agg(good).first()[0] for f in range(2)] for t in trees]
    assert np.allclose(got, want, rtol=1e-9)


def test_random_search_of_a_large_table_uses_cells(spark, rows, monkeypatch):
    prep = TR.prepare(rows.selectExpr("id", "y", "k as a", "id % 7 as b"), "y", ["id"], "regression")
    plain = TR.tune(prep, "reg_decision_tree", "random", n_iter=2)
    monkeypatch.setattr(cells, "SMALL", 0)
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda *a: pytest.fail("rows were fitted one by one"))
    params, score, model = TR.tune(prep, "reg_decision_tree", "random", n_iter=2)
    assert params == plain[0] and score == pytest.approx(plain[1], rel=1e-9)
    assert isinstance(model, cells._ForestModel)


def test_labels_and_features_that_spark_ml_refuses(spark, rows):
    bad = rows.select("features", F.when(F.col("id") != 7, F.col("y")).alias("y"))
    assert cells.pack(bad, "features", "y", "regression", small=0) is None
    assert cells.pack(rows, "features", "y", "classification", small=0) is None
    assert cells.pack(rows, "features", "y", "regression") is None


@pytest.mark.parametrize("key, label", [("reg_gb", "y"), ("clf_gb", "(k > 0)")])
def test_boosting_of_cells_is_spark_mls(rows, monkeypatch, tmp_path, key, label):
    data = rows.select("id", "features", F.expr(f"cast({label} as double)").alias("label"))
    est = make_estimator(key, {"n_estimators": 4, "max_depth": 2})
    plain = est.fit(data)
    monkeypatch.setattr(cells, "SMALL", 0)
    model = est.fit(data)
    model.write().save(str(tmp_path / "m"))
    a, b, c = ([r[0] for r in m.transform(data).orderBy("id").select("prediction").collect()]
               for m in (plain, model, TR.load_model(rows.sparkSession, str(tmp_path / "m"))))
    assert isinstance(model, cells.BinnedModel) and np.allclose(a, b, rtol=1e-9) and b == c


@pytest.mark.parametrize("key, label", [("reg_extra_trees", "y"), ("clf_extra_trees", "k")])
def test_extra_trees_of_cells_are_those_of_the_rows(spark, monkeypatch, key, label):
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 25, 2000), rng.integers(0, 6, 2000), rng.integers(0, 2, 2000)], 1)
    y = x[:, 0] + 3 * x[:, 2] + rng.integers(0, 5, 2000)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b) if i else None, float(b > 12) if i else None)
                                for i, (a, b) in enumerate(zip(x, y))], "id bigint, x array<double>, y double, k double")
    data = df.select("id", array_to_vector("x").alias("features"), F.col(label).alias("label"))
    est = make_estimator(key, {"n_estimators": 4, "min_samples_leaf": 5})
    plain = est.fit(data)
    monkeypatch.setattr(cells, "SMALL", 0)
    sizes = []
    monkeypatch.setattr(forest.ExtraTrees, "grown", lambda self, rows, *a, grown=forest.ExtraTrees.grown: sizes.append(rows.count()) or grown(self, rows, *a))
    model = est.fit(data)
    assert sizes[0] == data.where("label is not null").select("features").distinct().count() < 500
    assert np.array_equal(plain.feature, model.feature) and np.allclose(plain.value, model.value)
    a, b = ([r[0] for r in m.transform(data).orderBy("id").select("prediction").collect()] for m in (plain, model))
    assert np.allclose(a, b, rtol=1e-9)


@pytest.mark.parametrize("key, label", [("reg_extra_trees", "y"), ("clf_extra_trees", "k")])
def test_extra_trees_see_the_values_of_a_table_of_any_size(rows, monkeypatch, key, label):
    data = rows.select("id", "features", F.col(label).alias("label"))
    est = make_estimator(key, {"n_estimators": 3, "min_samples_leaf": 30})
    plain = est.fit(data)
    monkeypatch.setattr(cells, "SMALL", 0)
    model = est.fit(data)
    assert np.array_equal(plain.feature, model.feature) and np.array_equal(plain.cut, model.cut) and np.allclose(plain.value, model.value)
    # more cuts of the first feature than bins have edges
    assert len(np.unique(model.cut[model.feature == 0])) > cells.BINS


@pytest.mark.parametrize("key, target", [("reg_decision_tree", "y"), ("clf_decision_tree", "k")])
def test_learning_curve_of_a_large_table_reads_it_a_few_times(rows, monkeypatch, key, target):
    data = rows.select("id", target, F.expr("cast(id % 11 as double) a"), F.expr("cast(y * 3 as int) % 13 as b"))
    prep = TR.prepare(data, target, ["id"], "regression" if target == "y" else "classification")
    plain = [tuple(r) for r in X.learning_curve(prep, key, (0.3, 1.0), params={"max_depth": 4, "min_samples_leaf": 15}).collect()]
    monkeypatch.setattr(cells, "SMALL", 0)
    monkeypatch.setattr(cells, "pack", lambda *a: pytest.fail("rows were binned for every train set"))
    monkeypatch.setattr(type(data), "persist", lambda self, *a, keep=type(data).persist: keep(self) if "code" in self.columns else pytest.fail("rows were kept"))
    got = [tuple(r) for r in X.learning_curve(prep, key, (0.3, 1.0), params={"max_depth": 4, "min_samples_leaf": 15}).collect()]
    assert np.allclose(got, plain, rtol=1e-9) and got[0][1] < got[1][1]


def test_bins_have_values_between_their_cuts():
    x = np.random.default_rng(3).normal(size=4000).round(2)
    cut = cells.thresholds(x)
    value = cells.middles(x, cut)
    assert np.array_equal(np.searchsorted(cut, value), np.arange(32))
    assert cells.middles(np.array([1.0, 3.0, 1.0]), np.array([2.0])).tolist() == [1.0, 3.0] and len(cells.middles(np.ones(5), np.array([]))) == 1
