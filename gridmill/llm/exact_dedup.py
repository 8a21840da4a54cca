"""Exact dedup by a tree-merge of sorted digest runs.

Every partition sorts the digests of its documents into a run and folds equal neighbours to one entry:
the best document and the number of rows. The runs then meet in rounds. In round r the partitions whose
numbers differ only in digit r exchange what they hold: each takes the digests whose own digit r is its
digit, merges the sorted pieces and folds again. After the last round every digest is in one partition.
A partition never holds more than one entry per digest and run, so a text that a third of all rows share
costs a task at most as many entries as it has partners. Entries are equal only if SHA-256, a second hash
of other construction and the length all agree, at every level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.grouping import join_group_facts, keep_rows
from gridmill.llm.scratch import Scratch
from gridmill.llm.worker import lean

WHITE = b" \t\n\x0b\x0c\r"
KEY = ["digest", "check", "n_left"]
#: Of equal texts the first row in this order stays.
BEST = ["n_lost", "no_id", "doc_id", "row"]
FACTS = "doc_id bigint, raw bigint, n_chars bigint, digest binary, check bigint, n_left bigint, slot bigint"
RUN = (
    "digest binary, check bigint, n_left bigint, slot bigint, n_lost bigint, no_id boolean, doc_id bigint, "
    "row bigint, raw bigint, size bigint, place bigint"
)
FAN = 8


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        left = [t.translate(None, WHITE) for t in text.cast(pa.binary()).to_pylist()]
        sha = [hashlib.sha256(t).digest() for t in left]
        check = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True) for t in left]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("raw"),
                pc.utf8_length(text).cast(pa.int64()),
                pa.array(sha, pa.binary()), pa.array(check, pa.int64()),
                pa.array(map(len, left), pa.int64()),
                pa.array([int.from_bytes(d[:4], "big") for d in sha], pa.int64()),
            ],
            ["doc_id", "raw", "n_chars", "digest", "check", "n_left", "slot"],
        )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds neighbours of one key, best first, to one entry; the last key waits for the next batch."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table.cast(carry.schema)])
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for name in KEY:
            column = table.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        size = np.add.reduceat(table.column("size").to_numpy(), first)
        folded = table.take(pa.array(first))
        at = folded.schema.get_field_index("size")
        folded = folded.set_column(at, folded.schema.field(at), pa.array(size, pa.int64()))
        carry = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def digest_facts(docs: DataFrame) -> DataFrame:
    """One row of digests per document; ``raw`` hashes the text as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return source.withColumn("raw", F.xxhash64("text")).mapInArrow(lean(_digests), FACTS)


def tree_merge(facts: DataFrame, fan: int = FAN) -> DataFrame:
    """One entry per distinct text from ``facts`` with a ``row`` number: the best row and ``size``."""
    wanted = max(2, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rounds = max(1, math.ceil(math.log(wanted, fan) - 1e-9))
    fan = max(2, math.ceil(wanted ** (1 / rounds) - 1e-9))
    places = fan**rounds
    order = [*KEY, *BEST]
    runs = (
        facts.withColumns(
            {
                "n_lost": -F.col("n_chars"), "no_id": F.isnull("doc_id"), "size": F.lit(1).cast("bigint"),
                "place": (F.spark_partition_id() % places).cast("bigint"),
            }
        )
        .select(*[f.split()[0] for f in RUN.split(", ")])
        .sortWithinPartitions(*order)
        .mapInArrow(lean(_fold), RUN)
    )
    for step in (fan**r for r in range(rounds)):
        digit = lambda x: F.floor(x / F.lit(step)) % fan  # noqa: B023, E731
        moved = F.col("place") + (digit(F.col("slot")) - digit(F.col("place"))) * step
        runs = (
            runs.withColumn("place", moved.cast("bigint"))
            .repartitionById(places, F.col("place").cast("int"))
            .sortWithinPartitions(*order)
            .mapInArrow(lean(_fold), RUN)
        )
    return runs


def exact_dedup(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Each document with the document that stays for its text.

    Texts are equal when they are after deleting space, tab, line feed, vertical tab, form feed and
    carriage return; a null text counts as empty. Of equal texts the row with the most code points stays,
    then the smallest ``doc_id`` (null last), then one of the rows that still tie, so that exactly one row
    per text has ``kept``. Columns: doc_id, keep_id, group_size, kept, text_sha256, raw (hash of the text as
    it is). Other columns of ``docs`` are ignored, whatever their names; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    facts = scratch.store(digest_facts(docs).withColumn("row", F.monotonically_increasing_id()), "facts")
    groups = tree_merge(facts, fan).where("size > 1").select(
        *KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size")
    )
    groups = scratch.store(groups, "groups")
    joined = join_group_facts(facts, facts.count(), groups, KEY, "group_size")
    alone = F.isnull("facts")
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("facts.keep_id")).alias("keep_id"),
        F.coalesce("facts.group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("facts.keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "raw",
    )


def drop_copies(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_dedup``.

    Rows are told apart by doc_id and text. Rows that agree in both are copies of each other, too, and one
    of them stays.
    """
    return keep_rows(docs, exact_dedup(docs, fan).select("doc_id", "raw", "kept"))
