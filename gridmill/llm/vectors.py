"""Tables of vectors: which rows count, and their entries as one matrix per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192


def usable(vectors: DataFrame, limit: float, *others: str) -> tuple[DataFrame, int]:
    """vec_id, ``others`` and embedding (array of double) of the rows that have a whole vector, and its length.

    A row counts if its vector is not null, has no null, NaN or infinite entry and none of ``limit`` or more
    in size (beyond that, sums would leave 64 bits), and has the length that most such rows have (of two
    lengths with as many rows, the larger). With no such row the length is 0.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), *others, F.col("embedding").cast("array<double>").alias("embedding")
    )
    small = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < limit, F.lit(False)))
    whole = rows.where((F.size("embedding") > 0) & small)
    # One row per length that occurs, combined in the tasks; a single one reaches the driver.
    lengths = whole.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length = most.length if most else 0
    return whole.where(F.size("embedding") == length), length


def matrices(batches: Iterator[pa.RecordBatch], column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in slices of at most ``ROWS`` rows, each with its equally long lists as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, rows_of(part, column)


def rows_of(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel(), kind)
    )


def sums_by_slot(totals: np.ndarray) -> pa.RecordBatch:
    """The entries of a task's totals that are not zero, as rows (slot, value), to be added up over all tasks."""
    flat = totals.ravel()
    slot = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot])], ["slot", "value"])


def add_up(parts: DataFrame, n: int, dtype: type = np.int64) -> np.ndarray:
    """All ``n`` totals; the number of slots, not of rows, bounds what the driver gets."""
    out = np.zeros(n, dtype)
    for row in parts.groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[row.slot] = row.value
    return out
