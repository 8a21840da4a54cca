"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``nodes`` points of a ring; a key belongs to the arc before the next point clockwise. A
shard takes keys up to its share; what its arcs have beyond continues clockwise to the next point whose
shard has room. With shares that add up to the number of rows, the counts of the shards differ by one at
most. Where the keys of an arc end up depends only on how many keys each arc has, so the walk is made over
``shards * nodes`` counts, whatever the corpus, and gives ranges of ranks inside the arcs; each row finds
its shard by its rank in its arc.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.grouping import rank_in_class
from gridmill.llm.scratch import Scratch

BITS = 62


class Stay(NamedTuple):
    """Keys of ``arc`` from rank ``lo`` on, ``n`` of them, are in ``shard`` from ``slot`` on."""

    arc: int
    lo: int
    n: int
    shard: int
    slot: int


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise; one more shard leaves all other points in place."""
    point = lambda s, v: int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - BITS)
    return sorted((point(s, v), s) for s in range(shards) for v in range(nodes))


def walk_ring(owners: list[int], counts: list[int], room: list[int]) -> list[Stay]:
    """Where the keys of each arc stay; ``room`` is the share of each shard, together at least all keys."""
    if sum(room) < sum(counts):
        raise ValueError("The shards have less room than there are rows")
    room, taken, stays = list(room), [0] * len(room), []

    def take(arc: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            stays.append(Stay(arc, lo, n, shard, taken[shard]))
            taken[shard] += n
            room[shard] -= n
        return n

    beyond = []
    for arc, (shard, n) in enumerate(zip(owners, counts)):
        own = take(arc, 0, n, shard)
        beyond.append((own, n - own))
    moving: deque[tuple[int, int, int]] = deque()
    for turn in range(2 * len(owners)):  # the second round brings those that passed the start of the ring
        arc = turn % len(owners)
        while moving and room[owners[arc]]:
            source, lo, n = moving.popleft()
            here = take(source, lo, n, owners[arc])
            if here < n:
                moving.appendleft((source, lo + here, n - here))
        if turn < len(owners) and beyond[arc][1]:
            moving.append((arc, *beyond[arc]))
    return stays


def shard_documents(docs: DataFrame, shards: int, nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, under the law that row counts are even.

    ``size`` is the UTF-8 length of the text (null: empty) plus one, ``text_crc32`` its unsigned CRC-32. The
    ring hashes ``doc_id``; keys keep the order of their hash inside an arc, and rows of one hash (repeated
    or null ids, say half the table) are told apart by their stored order. The counts of any two shards
    differ by one at most; ``slot`` numbers the rows of a shard from 0 without gaps. With fewer rows than
    shards some shards stay empty; no rows give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ring-shards")
    points = ring(shards, nodes)
    edges, owners = [p for p, _ in points], [s for _, s in points]

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A key after the last point belongs to the first one.
            arc = np.searchsorted(np.array(edges), batch.column("point").to_numpy()) % len(edges)
            columns = [*batch.columns, pa.array(arc.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "arc"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 64 - BITS).alias("point"),
    ).mapInArrow(arcs, "doc_id bigint, size bigint, text_crc32 bigint, point bigint, arc int")
    rows = rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    rows = scratch.store(rows, "rows")
    # At most ``shards * nodes`` rows, whatever the corpus.
    found = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}
    n = sum(found.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    plan = defaultdict(list)
    for stay in walk_ring(owners, [found.get(a, 0) for a in range(len(owners))], room):
        plan[stay.arc].append(stay)
    tables = {arc: np.array(sorted(stays, key=lambda s: s.lo), np.int64) for arc, stays in plan.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc, rank = batch.column("arc").to_numpy(), batch.column("rank").to_numpy()
            shard, slot = np.empty(len(rank), np.int32), np.empty(len(rank), np.int64)
            for one in np.unique(arc):
                at = np.flatnonzero(arc == one)
                table = tables[int(one)]
                stay = table[np.searchsorted(table[:, 1], rank[at], "right") - 1]
                shard[at] = stay[:, 3]
                slot[at] = stay[:, 4] + rank[at] - stay[:, 1]
            kept = [batch.column(name) for name in ("doc_id", "size", "text_crc32")]
            columns = [*kept, pa.array(shard), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "text_crc32", "shard", "slot"])

    ranked = rank_in_class(rows, "arc", "part", ["point", "row"])
    return ranked.select("doc_id", "size", "text_crc32", "arc", "rank").mapInArrow(
        find, "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint"
    )
