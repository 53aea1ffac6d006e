import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabsmith.operators import preprocess as PP
from tabsmith.operators.ordered import interpolate_linear
from tabsmith.plans import steps as ST


@pytest.fixture()
def small(spark):
    pdf = pd.DataFrame({"id": range(40), "x": [float(i % 7) if i % 5 else None for i in range(40)],
                        "y": [float(i * i) for i in range(40)], "cat": ["a", "b", "c", "a"] * 10})
    return spark.createDataFrame(pdf).repartition(4)


def test_unknown_operation_raises():
    with pytest.raises(PP.StepError):
        PP.Step.from_spec({"operation": "nope"})


def test_standard_scale_inverse_identity(spark, small):
    m = PP.Step.from_spec({"operation": "scale", "params": {"columns": ["y"], "method": "standard"}}).fit(small)
    st = m.state()
    out = m.transform(small).select("id", "y").toPandas().sort_values("id")
    back = out["y"] * st["scale"]["y"] + st["center"]["y"]
    assert np.allclose(back, [float(i * i) for i in range(40)])


def test_onehot_row_sums_one(spark, small):
    out = PP.fit_transform(small, {"operation": "encode", "params": {"columns": ["cat"], "method": "onehot"}})
    pdf = out.select("cat_a", "cat_b", "cat_c").toPandas().astype(int)
    assert (pdf.sum(axis=1) == 1).all()


def test_pipeline_save_load_roundtrip(spark, small, tmp_path):
    spec = [{"name": "imp", "operation": "impute", "params": {"strategy": "median"}},
            {"name": "enc", "operation": "encode", "params": {"method": "label"}},
            {"name": "sc", "operation": "scale", "params": {"method": "robust"}}]
    assert ST.load_spec(ST.dump_spec(spec)) == spec
    model, out = ST.apply(small, spec)
    path = str(tmp_path / "pm")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(small)
    a = out.orderBy("id").toPandas()
    b = again.orderBy("id").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_validate_needs_target(spark, small):
    errs = ST.validate(small, [{"operation": "feature_selection", "params": {"method": "select_k_best"}}])
    assert errs and "target" in errs[0]


def test_interpolate_matches_pandas(spark, small):
    out = interpolate_linear(small, ["x"], ["id"]).toPandas().sort_values("id")
    exp = small.toPandas().sort_values("id")["x"].interpolate(limit_direction="both")
    assert np.allclose(out["x"].to_numpy(), exp.to_numpy())


def test_median_impute_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 10, 10]] + [(None,)], "v double")
    out = PP.fit_transform(df, {"operation": "impute", "params": {"strategy": "median"}})
    assert sorted(r[0] for r in out.collect())[3] == 2.5


def test_strategy_groups():
    g = ST.strategy_groups({"a": "mean", "b": "median", "c": "mean"})
    assert [s["params"]["columns"] for s in g] == [["a", "c"], ["b"]]
    json.dumps(g)


@pytest.mark.parametrize("method", ["label", "ordinal", "frequency", "target"])
def test_large_category_maps_belong_to_the_model(spark, tmp_path, monkeypatch, method):
    """More values than stay inline: one value with a third of the rows, nulls, unseen values; the saved step needs no checkpoint."""
    monkeypatch.setattr(PP, "HOT", 50)
    n = 6000
    rows = [("big" if i % 3 == 0 else None if i % 50 == 1 else f"v{i % 1500:05d}", float(i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "cat string, y double").repartition(5)
    step = PP.Step.from_spec({"operation": "encode", "params": {"columns": ["cat"], "method": method, "target": "y"}}).fit(df)
    named = next(iter(step.state()["columns"].values()))["map"]
    assert len(named["hot"]) == 50 and "path" in named
    step.write().overwrite().save(str(tmp_path / "step"))
    back = PP.FittedStep.load(str(tmp_path / "step"))
    assert back.state()["columns"]["cat"]["map"]["path"].startswith(str(tmp_path))
    odd = spark.createDataFrame([("never seen", 1.0)], "cat string, y double")
    for m in (step, back):
        got = m.transform(df.unionByName(odd).withColumn("was", F.col("cat"))).collect()
        assert len(got) == n + 1
        text = sorted({"nan" if c is None else c for c, _ in rows})
        for r in got[:: 37] + [x for x in got if x["was"] in (None, "big", "never seen")][:20]:
            key = "nan" if r["was"] is None else r["was"]
            mine = [y for c, y in rows if ("nan" if c is None else c) == key]
            if method == "label":
                assert r["cat"] == (text.index(key) if mine else None)
            elif method == "ordinal":
                assert r["cat"] == (text.index(key) if mine else -1.0)
            elif method == "frequency":
                assert r["cat"] == len(mine)
            else:
                want = sum(mine) / len(mine) if mine else sum(y for _, y in rows) / n
                assert abs(r["cat"] - want) < 1e-9
