"""Spark session helpers.

The library never hard-codes cluster paths.  Lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``; a private temp folder is only created when that
setting is absent and the master is local (local runs and tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "tabsmith",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session configured for analytical batch work."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # wide one-pass aggregates (profiles, correlation matrices) carry hundreds of buffer
        # fields; above this limit Spark silently drops whole-stage codegen for the whole stage
        "spark.sql.codegen.maxFields": "4000",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


RUNTIME_DEFAULTS = {"spark.sql.codegen.maxFields": ("100", "4000")}


def tune_session(spark: SparkSession) -> None:
    """Raise runtime SQL limits the wide aggregates need, only where they are at Spark's default."""
    for key, (default, wanted) in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, wanted)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabsmith-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of frames that nothing names any more.

    Spark removes them when the driver's garbage is collected, and a driver with room to spare collects too
    seldom: the files of all finished steps would lie on the disks until the job ends.  What has just ended is still
    named by Spark's own threads for a moment, so there are two rounds, and a wait for the files to go.
    """
    for _ in range(2):
        time.sleep(0.3)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so tasks import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_tabsmith_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tabsmith-pkg-")) / f"{here.name}.zip"     # served by the driver
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(str(target))
    sc._tabsmith_shipped = True
