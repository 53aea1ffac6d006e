import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tabsmith.operators import explain as X
from tabsmith.operators import preprocess as PP
from tabsmith.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tabsmith-stream-src-")
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice")
    li.write.mode("overwrite").parquet(src + "/in")
    sc = X.Scorer.sql("l_quantity * 1000 + l_extendedprice * 0.09", ["l_quantity", "l_extendedprice"])
    stream = spark.readStream.schema(li.schema).parquet(src + "/in")
    q = score_stream(stream, sc, src + "/out", src + "/ckpt", trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(src + "/out")
    assert out.count() == li.count()
    a = out.agg(F.sum("prediction")).first()[0]
    b = sc(li).agg(F.sum("prediction")).first()[0]
    assert abs(a - b) < 1e-6 * abs(b)


def test_sampling_shap_linear_expectation(spark):
    """For a linear scorer, the sampling Shapley value is exactly w_j (x_j - z_j) averaged over the
    background rows drawn -- so the sum over features equals f(x) - mean f(z drawn)."""
    raw = spark.read.parquet(f"{SF}/lineitem.parquet")      # no duplicate rows: all columns form a key
    li = raw.select(F.to_json(F.struct(*raw.columns)).alias("k"), "l_quantity", "l_discount")
    sc = X.Scorer.sql("l_quantity * 3 + l_discount * 100", ["l_quantity", "l_discount"])
    bg = li.orderBy("k").limit(50)
    phi = X.sampling_shap(li, sc, ["k"], bg, n_perm=5).groupBy("k").agg(F.sum("shap").alias("s"))
    pred = sc(li).select("k", "prediction")
    j = phi.join(pred, "k").toPandas()
    assert len(j) == li.count()
    assert len(j) > 0
    # phi sums lie between f(x) - max f(z) and f(x) - min f(z)
    fz = sc(bg).agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi")).first()
    assert ((j["prediction"] - j["s"] >= fz["lo"] - 1e-9) & (j["prediction"] - j["s"] <= fz["hi"] + 1e-9)).all()


def test_isolation_forest_drops_contamination_share(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y)) for x, y in rng.normal(size=(400, 2))] + [(50.0 + i, 50.0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    out = PP.fit_transform(df, {"operation": "outliers", "params": {"method": "isolation_forest",
                                                                    "contamination": 0.05}})
    kept = out.toPandas()
    assert 395 <= len(kept) <= 401
    assert (kept["a"] < 40).sum() >= 390          # the far points are the ones removed


def test_partial_dependence_linear(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    sc = X.Scorer.sql("2 * x + z", ["x", "z"])
    pd_ = X.partial_dependence(df, sc, "x", grid=[0.0, 10.0]).toPandas().sort_values("grid")
    mean_z = df.agg(F.avg("z")).first()[0]
    assert np.allclose(pd_["pd"].to_numpy(), [mean_z, 20 + mean_z])
