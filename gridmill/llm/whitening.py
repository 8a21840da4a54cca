"""Embedding whitening: projections on the principal directions, scaled to unit variance.

The covariance is never formed. Every task reduces its centred rows to a triangular factor by QR, one
block of rows after the other; the factors of the tasks are stacked and reduced in rounds until one is left,
whose singular values and right singular vectors the qd solver finds (``gridmill.llm.qd``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.qd import right_vectors
from gridmill.llm.scratch import Scratch
from gridmill.llm.vectors import add_up, lists, matrices, sums_by_slot, usable

SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more are no usable numbers: sums of that many rows would leave 64 bits.
LIMIT = float(1 << 20)
#: Bytes of the factors that one task of a round stacks.
STACK = 1 << 26


class Whitener(NamedTuple):
    n: int
    sums: np.ndarray  # of each dimension
    values: np.ndarray  # variances of the components, falling
    directions: np.ndarray  # unit vectors as columns
    trace: float  # of the covariance


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    """The entries as integers in steps of 1 / SCALE."""
    return np.floor(matrix * SCALE).astype(np.int64) + SHIFT


def scatter(x: np.ndarray, model: Whitener) -> np.ndarray:
    """n * x - S, exact."""
    return x * model.n - model.sums


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def triangular_factor(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows; vectors has the column embedding."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    d = len(sums)
    centre = Whitener(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    schema = "node bigint, factor array<double>"

    def row(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node]), lists(r.reshape(1, -1), pa.float64())], ["node", "factor"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, d))
        for _, matrix in matrices(batches):
            r = _factor(np.vstack([r, scatter(whole_numbers(matrix), centre) / n]))
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    fan = int(np.clip(STACK // (8 * d * d), 2, 32))

    def reduce_nodes(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        stacked = np.concatenate([f.values.to_numpy() for f in table.column("factor")]).reshape(-1, d)
        return pa.Table.from_batches([row(table.column("node")[0].as_py(), _factor(stacked))])

    nodes = scratch.store(vectors.select("embedding").mapInArrow(reduce_rows, schema), "round0")
    level = 0
    while (most := nodes.agg(F.max("node")).first()[0]) > 0:
        # Neighbours meet; how many rounds there are depends on the number of tasks, not of rows.
        up = nodes.withColumn("node", F.floor(F.col("node") / fan).cast("bigint"))
        level += 1
        nodes = scratch.store(up.groupBy("node").applyInArrow(reduce_nodes, schema), f"round{level}")
    r = np.array(nodes.first().factor).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def fit_whitener(vectors: DataFrame, length: int, components: int = 8) -> Whitener:
    """Moments and directions of the rows of ``usable``; with no rows n is 0.

    The driver holds sums and one triangular factor, whose size is that of the dimensions. Directions whose
    variance is only rounding are left out, so there may be fewer than ``components``.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(length + 1, np.int64)
        for _, matrix in matrices(batches):
            totals[:length] += whole_numbers(matrix).sum(0)
            totals[length] += len(matrix)
        yield sums_by_slot(totals)

    if not length:
        return Whitener(0, np.empty(0, np.int64), np.empty(0), np.empty((0, 0)), 0.0)
    found = add_up(vectors.select("embedding").mapInArrow(moments, "slot bigint, value bigint"), length + 1)
    n, sums = int(found[length]), found[:length]
    r = triangular_factor(vectors, n, sums) / np.sqrt(n)
    values, directions = right_vectors(r, components)
    return Whitener(n, sums, values, directions, float((r**2).sum()))


def project(matrix: np.ndarray, model: Whitener) -> np.ndarray:
    """Whitened rows: one column per component."""
    centred = scatter(whole_numbers(matrix), model) / model.n
    return centred @ model.directions / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """The largest difference between the covariance of all whitened rows and the identity, as measured."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k + 1, k))
        for _, matrix in matrices(batches):
            white = project(matrix, model)
            totals[:k] += white.T @ white
            totals[k] += white.sum(0)
        yield sums_by_slot(totals)

    parts = vectors.select("embedding").mapInArrow(products, "slot bigint, value double")
    totals = add_up(parts, (k + 1) * k, float).reshape(k + 1, k) / max(model.n, 1)
    # The rows are centred before they are multiplied; what rounding leaves of their mean is taken off.
    return float(np.abs(totals[:k] - np.outer(totals[k], totals[k]) - np.eye(k)).max(initial=0))


def deviations(x: np.ndarray, model: Whitener) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2 of every row, exact; None where it needs more than 64 bits."""
    parts = scatter(x, model)
    rough = (parts.astype(float) ** 2).sum(1)
    if rough.max(initial=0) < 2.0**62:
        return (parts**2).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in parts]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1, by falling variance), n, deviation,
    whitened, explained (its share of the variance) and identity_error.

    Entries become integers in steps of 1/1024. Which rows count is told by ``usable``; repeated rows count
    each, and a null vec_id stays. Components without variance have no whitened values and no rows: equal
    vectors give none. A deviation that does not fit into 64 bits is null. Other columns are ignored.
    """
    rows, length = usable(vectors, LIMIT)
    model = fit_whitener(rows, length, components)
    k = len(model.values)
    error = identity_error(rows, model) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, matrix in matrices(batches):
            n = batch.num_rows
            if not k or not n:
                continue
            every = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(every),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(deviations(whole_numbers(matrix), model), pa.int64()).take(every),
                    pa.array(project(matrix, model).ravel()),
                    pa.array(np.tile(model.values / model.trace, n)),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    schema = "vec_id bigint, component int, deviation bigint, whitened double, explained double"
    return rows.mapInArrow(run, schema).select(
        "vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )
