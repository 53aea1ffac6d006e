"""Apply a fitted model or scorer to a streaming DataFrame (T11 over streams).

The reference has no streaming operators; this only lets a model fitted by
this library score micro-batches.  Each batch is written with
``foreachBatch`` to Parquet (idempotent per epoch via a batch-id column),
with the stream's progress in ``checkpointLocation`` so the query resumes
after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, scorer, sink_path: str, checkpoint_location: str, trigger_once: bool = False):
    """Start a streaming query writing ``scorer(batch)`` rows (+ ``batch_id``) to ``sink_path``."""
    def write(batch: DataFrame, batch_id: int):
        out = scorer(batch) if callable(scorer) else scorer.transform(batch)
        (out.withColumn("batch_id", F.lit(batch_id))
            .write.mode("append").partitionBy("batch_id").parquet(sink_path))
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
