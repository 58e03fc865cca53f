"""What the operators on vectors share: usable rows, their packed form, and sums over all tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows that a task takes at a time.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component. An empty vector is usable."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def packed_vectors(df: DataFrame, ids: str, vector: str, dim: int, integers: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id and x (binary), written once: of each usable row of `dim` components, what `integers` makes of the matrix of its block;
    that gives the numbers and which rows to keep."""
    rows = df.select(F.col(ids).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).filter(usable(F.col("x")) & (F.size("x") == dim))
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, keep = integers(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            raw = np.ascontiguousarray(m)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in raw], pa.binary())], schema=schema).filter(pa.array(keep))

    return written(rows.mapInArrow(run, "vec_id bigint, x binary"), "vectors")


def blocks(batches: Iterable[pa.RecordBatch], dim: int, kind: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_ids, matrix) of at most BLOCK rows each."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            column = part.column("x")
            width = dim * np.dtype(kind).itemsize
            raw = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * width : (column.offset + len(column)) * width] if column.null_count == 0 and _even(column, width) else np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            yield part.column("vec_id"), raw.view(kind).reshape(-1, dim)


def _even(column: pa.Array, width: int) -> bool:
    """Whether the column's bytes start at the first byte of its buffer, row behind row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[: column.offset + len(column) + 1]
    return bool((ends == np.arange(len(ends)) * width).all())


def summed(vectors: DataFrame, of_task: Callable[[Iterable[pa.RecordBatch]], object], add: Callable):
    """The sum of what `of_task` gives for each task that has rows, by a tree of tasks, so that the driver gets few parts; None without
    any row. The parts are whatever JSON can hold, or bytes."""

    def run(batches):
        found = of_task(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found if isinstance(found, bytes) else json.dumps(found).encode()], pa.binary())], names=["part"])

    parts = vectors.mapInArrow(run, "part binary").rdd.map(lambda r: bytes(r.part))
    depth = 2 if parts.getNumPartitions() <= 4096 else 3

    def merge(a, b):
        return b if a is None else a if b is None else add(a, b)

    return parts.treeAggregate(None, merge, merge, depth)
