"""Sums of fixed-size vectors over all rows of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16


def vector_sum(rows: DataFrame, width: int, per_batch: Callable[[pa.RecordBatch], np.ndarray], dtype: str = "f8") -> np.ndarray | None:
    """The sum over all Arrow batches of per_batch(batch), width numbers: by partition, then PARTS of these together, and again, as often as it takes.

    None if rows has no partitions. No task holds more than PARTS vectors, nor does the driver.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype(dtype).tobytes()], pa.binary())], ["part", "total"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table.column("total"):
            total += np.frombuffer(x.as_buffer(), dtype)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // PARTS], pa.int32()), "total": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    kind, parts = "part int, total binary", rows.rdd.getNumPartitions()
    got = rows.mapInArrow(local, kind)
    while parts > 4:
        got = got.groupBy(F.floor(F.col("part") / PARTS).cast("int").alias("group")).applyInArrow(merge, kind)
        parts = -(-parts // PARTS)
    got = got.orderBy("part").collect()
    return sum(np.frombuffer(r.total, dtype).astype("f8") for r in got) if got else None
