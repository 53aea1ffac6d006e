"""Blocked sums: correlations, Gram matrices, one-pass ridge search; keyed permutations; search spaces."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsmith.functions import correlation
from tabsmith.operators import estimators, explain, linear_cv
from tabsmith.plans import cards


@pytest.mark.parametrize("narrow", [0, 16])
def test_correlations_equal_pandas(spark, monkeypatch, narrow):
    monkeypatch.setattr(correlation, "NARROW", narrow)
    monkeypatch.setattr(correlation, "BLOCK", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 10 + 1000
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=200)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 6] = 5.0
    x[:, 7] = np.nan
    names = [f"v{i}" for i in range(8)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    corr, shared = correlation.correlation_matrix(df, [F.col(n) for n in names])
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    off = ~np.eye(8, dtype=bool)
    assert np.allclose(corr[off], want[off], atol=1e-9, equal_nan=True)
    there = ~np.isnan(x)
    assert (shared == there.T.astype(int) @ there.astype(int)).all()


def test_gram_blocks_and_ridge_folds(spark, monkeypatch):
    monkeypatch.setattr(estimators, "BLOCK", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) + 2
    y = x @ [1, -2, 0, 3, 0.5] + rng.normal(size=300)
    fold = rng.integers(0, 3, 300)
    rows = [(r.tolist(), float(t), int(k)) for r, t, k in zip(x, y, fold, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(4).withColumn("features", array_to_vector("x"))
    g = estimators.gram_by_group(df, "features", "label", "fold")
    for k in range(3):
        m = fold == k
        assert g[str(k)]["n"] == m.sum() and np.allclose(g[str(k)]["G"], x[m].T @ x[m]) and np.allclose(g[str(k)]["xy"], x[m].T @ y[m])
    for alpha, k, r2 in linear_cv.ridge_cv(df, "features", "label", "fold", [0.1, 10.0]):
        tr, te = fold != int(k), fold == int(k)
        xc, yc = x[tr] - x[tr].mean(0), y[tr] - y[tr].mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ yc)
        e = y[te] - (y[tr].mean() + (x[te] - x[tr].mean(0)) @ w)
        assert np.isclose(r2, 1 - (e ** 2).mean() / y[te].var())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 1000, 4097])
def test_keyed_permutations_are_bijections(n):
    for key in (0, 1, 42_000_126):
        assert sorted(explain.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_permutations_move_values():
    a, b = (explain.permuted(np.arange(2000), 2000, k) for k in (5, 6))
    assert (a != b).mean() > 0.99 and (a != np.arange(2000)).mean() > 0.99
    assert abs(np.corrcoef(a, np.arange(2000))[0, 1]) < 0.1


def test_numbered_rows_and_importance(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", F.col("a") * 2).repartition(6)
    rows, n = explain.numbered(df)
    assert n == 1000 and sorted(r["__pos"] for r in rows.collect()) == list(range(1000))
    got = {r["feature"]: r for r in explain.permutation_importance(df, explain.Scorer.sql("a * 2", ["a", "b"]), "y", [], repeats=3).collect()}
    # a permuted exact model has R^2 of about minus one: a drop of two
    assert 1.7 < got["a"]["importance_mean"] < 2.3 and abs(got["b"]["importance_mean"]) < 1e-9


def test_search_spaces_and_trials():
    assert cards.param_space("reg_random_forest") == {"n_estimators": [100, 200, 400], "max_depth": [1, 2]}
    assert cards.param_space("clu_dbscan") == {"eps": [0.25, 0.5, 1.0], "min_samples": [2, 5, 10]}
    assert cards.param_space("reg_linear") == {} and cards.grid("reg_linear") == [{}]
    assert cards.param_space("reg_svr")["kernel"] == ["linear", "rbf", "poly", "sigmoid"]
    assert len(cards.random_trials("reg_xgboost", 100)) == 25 and len(cards.bounded_trials("reg_ridge", 100)) == 50
    for t in cards.bounded_trials("reg_gb"):
        assert 150 <= t["n_estimators"] <= 600 and 0.025 <= t["learning_rate"] <= 0.1
