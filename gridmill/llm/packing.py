"""Best-fit packing of token pieces with large-item matching.

How a piece is placed depends on its length alone, so the plan is made on the number of pieces of each
length: at most ``capacity`` numbers, whatever the corpus. At most two pieces of more than a third of the
capacity share a sequence; these are matched greedily, the longest with the longest that still fits. The
shorter pieces, longest first, then go to the sequences with the smallest gap that takes them. The plan is
a list of ranges of ranks; each piece finds its place by its rank among the pieces of its length, which
Spark works out in parts of bounded size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.grouping import rank_in_class
from gridmill.llm.pretokens import PieceCache, byte_level_ranks, cut, text_slices
from gridmill.llm.scratch import Scratch
from gridmill.llm.worker import lean, remembered_by


class Run(NamedTuple):
    """Pieces of ``length`` from rank ``lo`` on: ``each`` per sequence, from ``offset`` on, in ``n`` sequences."""

    length: int
    lo: int
    each: int
    n: int
    sequence: int
    offset: int


def plan_sequences(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Places for ``counts[length]`` pieces of each length; together they tile every sequence from 0."""
    left = {length: n for length, n in counts.items() if n}
    runs: list[Run] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    sizes: list[int] = []  # the gaps that have sequences, ascending
    made = 0

    def place(length: int, each: int, n: int, sequence: int, gap: int) -> None:
        runs.append(Run(length, used[length], each, n, sequence, capacity - gap))
        used[length] += each * n
        left[length] -= each * n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap not in gaps:
            insort(sizes, gap)
        gaps[gap].append((sequence, n))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        partner = large[at] if at >= 0 else 0
        if partner == longest:
            n, rest = divmod(left[longest], 2)
            if n:
                place(longest, 2, n, made, capacity)
                leave(capacity - 2 * longest, made, n)
                made += n
            if rest:  # the odd one takes a shorter partner in the next turn
                large = large[:-1]
                partner = large[-1] if large else 0
                place(longest, 1, 1, made, capacity)
                if partner:
                    place(partner, 1, 1, made, capacity - longest)
                leave(capacity - longest - partner, made, 1)
                made += 1
        else:
            n = min(left[longest], left[partner]) if partner else left[longest]
            place(longest, 1, n, made, capacity)
            if partner:
                place(partner, 1, n, made, capacity - longest)
            leave(capacity - longest - partner, made, n)
            made += n
        large = [length for length in large if left[length]]
    for length in sorted((length for length in left if left[length]), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left[length] // (capacity // length))
                leave(capacity, made, n)
                made += n
                at = bisect_left(sizes, length)
            gap = sizes[at]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                place(length, each, full, sequence, gap)
                leave(gap - each * length, sequence, full)
            if full < n and left[length]:
                last = left[length]
                place(length, last, 1, sequence + full, gap)
                leave(gap - last * length, sequence + full, 1)
                full += 1
            if full < n:
                leave(gap, sequence + full, n - full)
    return runs


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, for a byte-level BPE file in JSON."""

    def __init__(self, path: str, pattern: str, remember: int = 200_000):
        ranks, self.special = byte_level_ranks(path)
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = PieceCache(self._piece, remember)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        for string, i in self.special.items():
            if string in text:
                return np.array([i], "<u4").tobytes().join(map(self.encode, text.split(string)))
        first, *rest = cut(text)
        ids = self._piece(first) + b"".join(map(self.pieces.__getitem__, rest))
        self.pieces.trim()
        return ids


@remembered_by("packing")
@lru_cache(maxsize=2)
def text_ids(path: str, pattern: str) -> TextIds:
    return TextIds(path, pattern)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """The pieces of every document: its ids, ``end_id``, cut to ``capacity`` from the end where longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = text_ids(path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = coder.encode(text) + end
                    n = len(ids) // 4
                    stops = range((n - 1) % capacity + 1, n + 1, capacity)
                    for k, stop in enumerate(stops):
                        start = max(0, stop - capacity) if k else 0
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc, k, start, stop - start, zlib.crc32(own), own))
                columns = list(zip(*rows))[: None if with_ids else -1] if rows else []
                if columns:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: None if with_ids else -1]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(lean(run, "packing"), PIECES + ", ids binary" * with_ids)


def pack_documents(
    docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is the ids of its text (null: empty) and ``end_id``. One of more than ``capacity`` ids is cut
    into pieces of ``capacity``, of which the first may be shorter; no other is cut. Sequences take at
    most ``capacity`` ids and are filled from offset 0 without gaps. ``with_ids`` adds the ids of each piece
    as little-endian unsigned 32-bit numbers. An empty text is one piece with only ``end_id``; equal rows are
    packed each for itself; no rows give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, path, pattern, end_id, capacity, with_ids)
    pieces = pieces.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    pieces = scratch.store(pieces, "pieces")
    # At most ``capacity`` rows, whatever the corpus.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = defaultdict(list)
    for run in plan_sequences(counts, capacity):
        runs[run.length].append(run)
    tables = {length: np.array(sorted(own, key=lambda r: r.lo), np.int64) for length, own in runs.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                table = tables[int(one)]
                found = table[np.searchsorted(table[:, 1], rank[at], "right") - 1]
                nth, inside = np.divmod(rank[at] - found[:, 1], found[:, 2])
                sequence[at] = found[:, 4] + nth
                offset[at] = found[:, 5] + inside * one
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    names = [c for c in pieces.columns if c not in ("part", "row")]
    ranked = rank_in_class(pieces, "length", "part", ["row"]).select(*names, "rank")
    return ranked.mapInArrow(lean(find, "packing"), PIECES + ", ids binary" * with_ids + ", sequence_id bigint, offset bigint")
