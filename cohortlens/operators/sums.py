"""Sums of NumPy vectors over partitions, added in a tree of bounded fan-in.

A task returns its partial sum as one row (part, sums); ``FAN`` of them are
added at a time, so neither a task nor the driver gathers all partial sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32
SCHEMA = "part long, sums binary"
ARROW = pa.schema([("part", pa.int64()), ("sums", pa.binary())])


def partial(sums: np.ndarray) -> pa.RecordBatch:
    """The row that a task returns."""
    from pyspark import TaskContext
    return pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": np.asarray(sums, float).tobytes()}], ARROW)


def _add(key, group):
    total = np.sum([np.frombuffer(s.as_py()) for s in group["sums"]], axis=0)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def tree_sum(parts: DataFrame, n_parts: int) -> np.ndarray | None:
    """Sum of the partial sums of ``n_parts`` partitions; None without any."""
    while n_parts > 1:
        n_parts = -(-n_parts // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(_add, SCHEMA)
    rows = parts.collect()
    return np.frombuffer(bytes(rows[0]["sums"])) if rows else None
