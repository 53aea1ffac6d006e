"""Sums (or minima) of large arrays over all rows, kept on Spark.

An aggregate whose state is an array (a Gram block, the label sums of thousands of tree nodes, bootstrap sums)
is built in two steps: every task adds its rows into NumPy arrays and emits one row per block; the rows of
a block are shuffled to one task, sorted, and folded as a stream, so a task holds one block whatever the number of
partials.  The driver sees finished blocks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "block bigint, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def rows_of(blocks) -> pa.RecordBatch:
    """A batch of (block, float64 array) pairs."""
    blocks = list(blocks)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int64()),
                                       pa.array([np.ascontiguousarray(x, np.float64).tobytes() for _, x in blocks], pa.binary())], schema=_ARROW)


def fold(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]],
         add: np.ufunc | dict[int, np.ufunc] = np.add, parts: int | None = None, alone: bool = False) -> DataFrame:
    """(block, data) of every block that ``partial`` emits in any task, combined by ``add``.

    ``partial`` gets a task's batches and yields (block, array) pairs; arrays of one block have one length.
    ``add`` may differ by block (those not named are summed).  ``alone`` says that ``df`` has one partition, whose
    blocks (each yielded once) are the result.
    """
    def task(batches):
        for pair in partial(batches):
            yield rows_of([pair])

    def together(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for block, run in groupby(rows, key=lambda r: r[0]):
            total, op = None, add.get(block, np.add) if isinstance(add, dict) else add
            for _, data in run:
                x = np.frombuffer(data.as_buffer(), np.float64)
                if total is None:
                    total = x.copy()
                else:
                    op(total, x, out=total)
            yield rows_of([(block, total)])

    emitted = df.mapInArrow(task, SCHEMA)
    if alone:
        return emitted
    dealt = emitted.repartition(parts, "block") if parts else emitted.repartition("block")
    return dealt.sortWithinPartitions("block").mapInArrow(together, SCHEMA)


def dealt_out(df: DataFrame, least: int = 20_000, most: int | None = None) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has task slots, and of at most about ``most`` rows each.

    For work that is much larger than its rows: a file's few row groups would else keep a few slots busy.  A partition
    is not cut below ``least`` rows, so a small table stays as it is.
    """
    n, have = df.count(), df.rdd.getNumPartitions()
    want = max(min(df.sparkSession.sparkContext.defaultParallelism, n // least), -(-n // most) if most else 0)
    return df.repartition(want) if want > have else df


def collected(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Finished blocks on the driver: as many numbers as the arrays have, whatever the number of rows or tasks."""
    return {r["block"]: np.frombuffer(r["data"], np.float64) for r in blocks.collect()}


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))
