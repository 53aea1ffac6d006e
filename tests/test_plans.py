"""Plan-shape invariants: no row-pair joins anywhere, column pruning reaches the scan."""
import pytest
from pyspark.sql import functions as F

from tabsmith.plans.catalog import load_all

QUERIES, _ = load_all()
SF = "/root/testdata/sf0.001"
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins(result, name):
    df = result(name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(b in plan for b in BAD), (name, [b for b in BAD if b in plan])


def test_profile_scan_reads_only_projected_columns(spark):
    from tabsmith.operators.profile import column_stats
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_quantity", "l_returnflag")
    plan = column_stats(li, with_quantiles=False)._jdf.queryExecution().executedPlan().toString()
    schemas = [s for s in plan.split("ReadSchema: ")[1:]]
    assert schemas and all("l_extendedprice" not in s and "l_orderkey" not in s for s in schemas)


def test_filter_pushed_to_scan(spark):
    from tabsmith.operators.metrics import regression_metrics
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_returnflag") == "R") \
        .select(F.lit("m").alias("model"), F.col("l_quantity").alias("label"), F.col("l_tax").alias("prediction"))
    plan = regression_metrics(li)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
