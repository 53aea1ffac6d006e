import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsmith.operators import compare as CMP
from tabsmith.operators import metrics as M
from tabsmith.operators import monitor as MON


def _pred(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, size=n)
    s = np.round(rng.random(size=n) * 0.5 + y * 0.3, 2)     # ties on purpose
    return spark.createDataFrame(pd.DataFrame({"row_id": range(n), "label": y, "score": s,
                                               "model": "m"})).repartition(4), y, s


def test_auc_matches_pairwise_brute_force(spark):
    df, y, s = _pred(spark)
    got = M.roc_auc(df, F.col("label") == 1, "score").first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)])
    assert abs(got - exp) < 1e-12


def test_ttest_antisymmetric(spark):
    rng = np.random.default_rng(0)
    rows = [(i, m, float(rng.random())) for i in range(50) for m in ("a", "b")]
    losses = spark.createDataFrame(rows, "row_id long, model string, loss double")
    t_ab = CMP.paired_ttest(losses, "b").first()["t"]
    t_ba = CMP.paired_ttest(losses, "a").first()["t"]
    assert abs(t_ab + t_ba) < 1e-12


def test_psi_of_identical_tables_is_zero(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("v"))
    r = MON.psi(df, df).first()
    assert abs(r["psi"]) < 1e-12


def test_confusion_and_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    m = M.classification_metrics(df.withColumn("model", F.lit("x"))).first()
    assert m["accuracy"] == 0.5
    assert m["matthews_corr"] is None          # > 2 true classes


def test_student_p_against_known_quantiles(spark):
    """Two-sided 5 % and 1 % points from the published tables, and the limits."""
    known = [(4.3026527, 2, 0.05), (2.7764451, 4, 0.05), (2.2281389, 10, 0.05), (3.1692727, 10, 0.01), (1.9839715, 100, 0.05),
             (1.9599640, 10**8, 0.05), (0.0, 7, 1.0), (-2.2281389, 10, 0.05), (60.0, 1000, 0.0)]
    df = spark.createDataFrame([(float(t), n, p) for t, n, p in known], "t double, df long, p double")
    for r in df.withColumn("got", CMP.student_p(F.col("t"), F.col("df"))).collect():
        assert abs(r["got"] - r["p"]) < 2e-6, r
