"""Element-wise sums of arrays of a fixed size that tasks produce, without a driver loop.

A task yields its array in row shards (`shards`); `total` adds the shards in two
shuffles (first by shard and a sixteenth of the tasks, then by shard), streaming, so a
reducer holds one shard however many tasks there are, and collects the fixed-size sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "shard int, sub int, sums binary"
SHARDS, SUBS = 16, 16


def _rows(parts: dict[int, np.ndarray], sub: int) -> Iterator[pa.RecordBatch]:
    for s, part in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([sub], pa.int32()), pa.array([part.tobytes()], pa.binary())],
            ["shard", "sub", "sums"])


def shards(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's contribution; a task without any yields nothing."""
    if array.any():
        parts = {s: np.ascontiguousarray(array[s::SHARDS]) for s in range(min(SHARDS, len(array)))}
        yield from _rows(parts, TaskContext.get().partitionId() % SUBS)


def total(parts: DataFrame, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Sum of the arrays (of this shape and type) whose shards `parts` holds."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column("shard").to_pylist(), batch.column("sums").to_pylist()):
                array = np.frombuffer(data, kind)
                sums[s] = sums[s] + array if s in sums else array
        yield from _rows(sums, 0)

    summed = parts.repartition("shard", "sub").mapInArrow(added, SCHEMA).repartition("shard").mapInArrow(added, SCHEMA)
    out = np.zeros(shape, kind)
    for row in summed.collect():                # at most SHARDS rows of a fixed size
        out[row["shard"]::SHARDS] += np.frombuffer(row["sums"], kind).reshape(-1, *shape[1:])
    return out
