"""Run history, recommender feedback and preferences as Parquet tables (S12-S15, SC3).

The reference upserts rows in SQLite.  Here every state change is an
appended event row (append-only Parquet is safe with concurrent writers
and executor loss); the current state is the latest event per key,
``row_number() over (partition by key order by event time desc, seq desc)``.
Run ids are UUIDs (the reference's millisecond ids collide).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN_SCHEMA = ("run_id string, created_at double, event_ts double, seq long, task_type string, algorithm_key string, "
              "model_name string, status string, metrics_json string, params_json string, artifact_path string")
FEEDBACK_SCHEMA = ("created_at double, user_id string, dataset_sig string, task_type string, profile string, "
                   "algorithm_key string, model_name string, score_total int, accepted int, payload_json string")
PREFS_SCHEMA = "user_id string, updated_at double, seq long, prefs_json string"


def new_run_id() -> str:
    return "run_" + uuid.uuid4().hex


def run_event(run_id, task_type, algorithm_key, model_name, status, metrics=None, params=None,
              artifact_path=None, created_at=None, seq=0):
    now = time.time()
    return (run_id, float(created_at if created_at is not None else now), now, int(seq), task_type, algorithm_key,
            model_name, status, json.dumps(metrics or {}), json.dumps(params or {}), artifact_path)


def save_runs(spark: SparkSession, path: str, events: list[tuple]) -> None:
    """S12 write side: append run events (queued / running / finished / failed)."""
    spark.createDataFrame(events, RUN_SCHEMA).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """S12 read side / W3: the latest event per run_id; a failed event keeps earlier non-empty fields."""
    w = Window.partitionBy("run_id").orderBy(F.col("event_ts").desc(), F.col("seq").desc())
    latest = runs.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")
    return latest


def list_runs(runs: DataFrame, limit: int = 200) -> DataFrame:
    """Newest first."""
    return latest_runs(runs).orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def run_metrics(runs: DataFrame) -> DataFrame:
    """SC3: metrics JSON -> map and 'k=v' text."""
    m = F.from_json("metrics_json", "map<string,double>")
    kv = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="),
                                                                      F.format_number(e["value"], 4))), ", ")
    return runs.select("run_id", m.alias("metrics"), kv.alias("metrics_text"))


def append_feedback(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append accept / reject events."""
    spark.createDataFrame(rows, FEEDBACK_SCHEMA).write.mode("append").parquet(path)


def append_feedback_rows(rows: DataFrame, path: str) -> None:
    """S14 for events that Spark already holds; columns of the schema that ``rows`` lacks are null."""
    schema = rows.sparkSession.createDataFrame([], FEEDBACK_SCHEMA).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]) \
        .write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)


def save_prefs(spark: SparkSession, path: str, user_id: str, prefs: dict, seq: int = 0) -> None:
    spark.createDataFrame([(user_id or "default", time.time(), seq, json.dumps(prefs))], PREFS_SCHEMA) \
        .write.mode("append").parquet(path)


def latest_prefs(prefs: DataFrame) -> DataFrame:
    """Last write wins per user."""
    w = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    return prefs.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")
