"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The codebooks are fitted in rounds over all vectors. Between the rounds every part keeps its closest
entries in order, a lower bound of the distance to each, and one outer bound for all entries that are not in
the list (Drake and Hamerly's adaptive bounds). When entries have moved, the bounds loosen by how far; where
the first entry is still surely nearer than the next bound, the part keeps it without any distance. Where that
is not sure, exact integer distances settle it: of the first few entries of the list if a bound ends them, and
of all entries otherwise. How long the lists are is adapted to how many entries the rounds before had to look at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.grouping import join_group_facts
from gridmill.llm.scratch import Scratch
from gridmill.llm.vectors import add_up, lists, matrices, rows_of, sums_by_slot, usable

#: A component of a vector in units of 1 / SCALE, and the size from which on it is no usable number.
SCALE = 4096
LIMIT = float(1 << 14)
#: Bounds are kept in 32 bits, rounded to the safe side by more than their rounding.
SAFE = 1e-6
STATE = "near array<tinyint>, low array<float>, outer array<float>, used array<tinyint>"


class Bounds(NamedTuple):
    """For each of many parts: closest entries in order (-1: not known), ``low[:, 0]`` an upper bound of the
    distance to the first, ``low[:, j]`` a lower bound for the entry j and all after it, ``outer`` for those
    not in the list; ``used`` is how many entries had to be looked at."""

    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    used: np.ndarray


def quantise(matrix: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, position) integers; a length that ``parts`` does not divide is filled up with zeros."""
    whole = np.floor(matrix * SCALE).astype(np.int64)
    lacks = -matrix.shape[1] % parts
    return np.pad(whole, ((0, 0), (0, lacks))).reshape(len(matrix), parts, -1)


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) values to (n, m, width) or (m, width) entries."""
    return ((values[:, None, :] - entries) ** 2).sum(-1)


def ranked(squares: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by rising distance, ties to the lower number, and the distances in that order."""
    order = np.lexsort((entries, squares), axis=1)
    return np.take_along_axis(entries, order, 1), np.take_along_axis(squares, order, 1)


def closest(values: np.ndarray, part: np.ndarray, books: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all entries; ``part`` is the codebook of each of the values."""
    n, k = len(values), books.shape[1]
    squares = np.empty((n, k), np.int64)
    for p in range(len(books)):
        mine = np.flatnonzero(part == p)
        squares[mine] = distances(values[mine], books[p])
    near, squares = ranked(squares, np.broadcast_to(np.arange(k), (n, k)))
    far = np.sqrt(squares)
    outer = far[:, b] if b < k else np.full(n, np.inf)
    return Bounds(near[:, :b].copy(), far[:, :b].copy(), outer, np.full(n, k))


def resize(bounds: Bounds, b: int) -> Bounds:
    """The same bounds with lists of ``b`` entries: what is cut off goes into the outer bound."""
    near, low, outer, used = bounds
    have = near.shape[1]
    if b < have:
        outer = np.minimum(outer, low[:, b:].min(1))
        return Bounds(near[:, :b].copy(), low[:, :b].copy(), outer, used)
    more = b - have
    near = np.hstack([near, np.full((len(near), more), -1)])
    return Bounds(near, np.hstack([low, np.repeat(outer[:, None], more, 1)]), outer, used)


def in_order(low: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Each lower bound made to hold for all entries after it, too; the first column, an upper bound, stays."""
    tail = np.minimum(low[:, 1:], outer[:, None])
    low[:, 1:] = np.minimum.accumulate(tail[:, ::-1], 1)[:, ::-1]
    return low


def moved(bounds: Bounds, values: np.ndarray, part: np.ndarray, books: np.ndarray, old: np.ndarray) -> Bounds:
    """Bounds and nearest entries after the codebooks ``old`` have become ``books``."""
    near, low, outer, _ = bounds
    n, b = near.shape
    k = books.shape[1]
    step = np.sqrt(((books - old) ** 2).sum(-1)) * (1 + SAFE)
    known = near >= 0
    shift = np.where(known, step[part[:, None], np.maximum(near, 0)], step.max(1)[part][:, None])
    upper = low[:, 0] + shift[:, 0]
    low = low - shift
    outer = outer - step.max(1)[part]
    low[:, 0] = upper
    low = in_order(low, outer)
    used = np.zeros(n, np.int64)

    # The first entry stays if its upper bound, and then its true distance, is below the next lower bound.
    first_after = low[:, 1] if b > 1 else outer
    unsure = np.flatnonzero(upper >= first_after)
    exact = ((values[unsure] - books[part[unsure], near[unsure, 0]]) ** 2).sum(-1)
    low[unsure, 0] = np.sqrt(exact) * (1 + SAFE)
    used[unsure] = 1
    unsure = unsure[low[unsure, 0] >= first_after[unsure]]

    # How many entries of the list can be nearest: those before the first bound above the distance.
    ends = np.hstack([low[unsure, 1:], outer[unsure, None]]) > low[unsure, :1]
    counts = np.where(ends.any(1), ends.argmax(1) + 1, k + 1)
    counts[(counts <= b) & (near[unsure, np.minimum(counts, b) - 1] < 0)] = k + 1
    for m in range(2, b + 1):
        at = unsure[counts == m]
        if len(at):
            entry, squares = ranked(distances(values[at], books[part[at][:, None], near[at, :m]]), near[at, :m])
            near[at, :m] = entry
            low[at, :m] = np.sqrt(squares) * (1 - SAFE)
            low[at, 0] = np.sqrt(squares[:, 0]) * (1 + SAFE)
            used[at] = m
    at = unsure[counts > b]
    if len(at):
        near[at], low[at], outer[at], used[at] = closest(values[at], part[at], books, b)
    return Bounds(near, in_order(low, outer), outer, used)


def _columns(bounds: Bounds, n: int) -> list[pa.Array]:
    """The state of ``n`` rows as Arrow columns; upper bounds round up, lower bounds down."""
    low = bounds.low * (1 - SAFE)
    low[:, 0] = bounds.low[:, 0] * (1 + SAFE)
    return [
        lists(bounds.near.reshape(n, -1).astype(np.int8), pa.int8()),
        lists(low.reshape(n, -1).astype(np.float32), pa.float32()),
        lists((bounds.outer * (1 - SAFE)).reshape(n, -1).astype(np.float32), pa.float32()),
        lists(bounds.used.reshape(n, -1).astype(np.int8), pa.int8()),
    ]


def _bounds(part: pa.RecordBatch, parts: int) -> Bounds:
    get = lambda name, width: rows_of(part, name).reshape(part.num_rows * parts, width)
    near = get("near", -1).astype(np.int64)
    return Bounds(near, get("low", -1).astype(float), get("outer", 1)[:, 0].astype(float), get("used", 1)[:, 0])


class Fitted(NamedTuple):
    codes: DataFrame  # vec_id, label, code, error
    books: np.ndarray  # part, entry, position
    lengths: list[int]  # of the lists in each round


def fit_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Fitted:
    """Codebooks after ``rounds`` rounds over all vectors, and every vector's code and squared error.

    The codebooks start as the parts of the ``entries`` rows with the smallest vec_id (null last, equal ids by
    their vectors); with fewer rows they have fewer entries. A round gives every part its nearest entry, ties
    to the lower number, and replaces each entry by the floor of its parts' mean; an entry without parts stays.
    Which rows count is told by ``usable``; repeated rows count each; other columns are ignored.

    Each round reads the table that the last one stored in the shared folder, and the driver holds codebooks
    and sums only, whose size is that of ``entries`` vectors. Tables of rounds that are done are deleted.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    rows, length = usable(vectors, LIMIT, "label")
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    kind = "vec_id bigint, label int, whole array<int>"
    if not head:
        none = spark.createDataFrame([], "vec_id bigint, label int, code string, error bigint")
        return Fitted(none, np.zeros((parts, 0, 0), np.int64), [])
    books = quantise(np.array([r.embedding for r in head]), parts).transpose(1, 0, 2).copy()
    k, width = books.shape[1:]
    label = F.col("label").cast("int").alias("label")

    def whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, matrix in matrices(batches):
            flat = quantise(matrix, parts).reshape(len(matrix), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists(flat, pa.int32())], ["vec_id", "label", "whole"]
            )

    rows = rows.select("vec_id", label, "embedding").mapInArrow(whole_numbers, kind)
    b = max(1, k // 4)
    lengths = []
    state, old = None, books

    def assign(table: DataFrame, books: np.ndarray, old: np.ndarray, b: int, begin: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, matrix in matrices(batches, "whole"):
                values = matrix.reshape(-1, width).astype(np.int64)
                part = np.tile(np.arange(parts), batch.num_rows)
                if begin:
                    bounds = closest(values, part, books, b)
                else:
                    bounds = moved(resize(_bounds(batch, parts), b), values, part, books, old)
                keep = [batch.column(c) for c in ("vec_id", "label", "whole")]
                yield pa.RecordBatch.from_arrays(
                    keep + _columns(bounds, batch.num_rows), ["vec_id", "label", "whole", "near", "low", "outer", "used"]
                )

        return table.mapInArrow(run, f"{kind}, {STATE}")

    def totals(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and counts of the parts of every entry, and how many parts looked at how many entries."""
        size = parts * k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, width + 1), np.int64)
            looked = np.zeros(k + 1, np.int64)
            for batch, matrix in matrices(batches, "whole"):
                values = matrix.reshape(-1, width).astype(np.int64)
                first = rows_of(batch, "near").reshape(len(values), -1)[:, 0].astype(np.int64)
                slot = np.tile(np.arange(parts) * k, batch.num_rows) + first
                order = np.argsort(slot, kind="stable")
                here, starts = np.unique(slot[order], return_index=True)
                sums[here, :width] += np.add.reduceat(values[order], starts, axis=0)
                sums[here, width] += np.diff(np.append(starts, len(slot)))
                looked += np.bincount(rows_of(batch, "used").ravel(), minlength=k + 1)
            yield sums_by_slot(np.concatenate([sums.ravel(), looked]))

        parts_of = table.select("whole", "near", "used").mapInArrow(run, "slot bigint, value bigint")
        found = add_up(parts_of, size * (width + 1) + k + 1)
        sums = found[: size * (width + 1)].reshape(parts, k, width + 1)
        return sums[..., :width], sums[..., width:], found[size * (width + 1) :]

    for number in range(rounds):
        table = assign(rows if state is None else state, books, old, b, state is None)
        last, state = state, scratch.store(table, f"round{number}")
        if last is not None:
            scratch.drop(f"round{number - 1}")
        lengths.append(b)
        sums, counts, looked = totals(state)
        old, books = books, np.where(counts > 0, sums // np.maximum(counts, 1), books)
        if number:
            # So long that 19 of 20 parts find the end of their search in the list, an eighth to half of all entries.
            share = np.cumsum(looked) / looked.sum()
            b = int(np.clip(np.searchsorted(share, 0.95) + 1, max(1, k // 8), max(1, k // 2)))

    def finish(table: DataFrame, books: np.ndarray, old: np.ndarray, b: int, begin: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digits = np.array([f"{i:02x}" for i in range(k)])
            for batch, matrix in matrices(batches, "whole"):
                values = matrix.reshape(-1, width).astype(np.int64)
                part = np.tile(np.arange(parts), batch.num_rows)
                if begin:
                    bounds = closest(values, part, books, b)
                else:
                    bounds = moved(resize(_bounds(batch, parts), b), values, part, books, old)
                first = bounds.near[:, 0]
                error = ((values - books[part, first]) ** 2).sum(-1).reshape(-1, parts).sum(1)
                code = ["".join(row) for row in digits[first.reshape(-1, parts)].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

        return table.mapInArrow(run, "vec_id bigint, label int, code string, error bigint")

    codes = finish(rows if state is None else state, books, old, b, state is None)
    lengths.append(b)
    return Fitted(scratch.store(codes, "codes"), books, lengths)


def books_sha256(books: np.ndarray) -> str:
    """Lowercase hex digest of all components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(fitted: Fitted) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows of the label, nulls together), codebooks_sha256."""
    codes = fitted.codes.withColumns({"no_label": F.col("label").isNull(), "kind": F.coalesce("label", F.lit(0))})
    scratch = Scratch(codes.sparkSession, "label-errors")
    by_label = codes.groupBy("no_label", "kind").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    by_label = scratch.store(by_label, "labels")
    n_rows = by_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_group_facts(codes, n_rows, by_label, ["no_label", "kind"], "n").select(
        "vec_id", "code", "error", F.col("facts.label_error").alias("label_error"),
        F.lit(books_sha256(fitted.books)).alias("codebooks_sha256"),
    )
