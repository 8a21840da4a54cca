"""Repeated passages by a sparse suffix array.

A suffix of a text starts at one of its words and goes on to its end. Kept are only the suffixes at
minimiser positions: of every ``min_words`` words in a row, the place whose ``gram`` words have the smallest
hash. Equal passages select equal places, so two passages of ``min_words`` words always share one.

1. The suffixes are sorted by their first words over all partitions and compared with their neighbours.
   Those that share their first ``gram`` words with a neighbour go on. Where the whole neighbourhood of a
   place agrees with an earlier suffix, left and right, everything around it is a copy and is settled.
2. The matches of all others are extended: each stretch of ``min_words`` words that holds the shared words
   is looked up, from the farthest left to the farthest right, by sorting their hashes and comparing
   neighbours. The first document that has a stretch keeps it, the stretches of the others are copies.
3. Overlapping stretches of a document are joined to passages.

Texts that share nothing long are never compared, and groups of any size are handled as sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.bitmap import bit_map, split_by_map
from gridmill.llm.grouping import likely_rows
from gridmill.llm.pretokens import text_slices
from gridmill.llm.scratch import Scratch
from gridmill.llm.words import Words, mix, rolling_hashes, second_hashes, split_words, text_bytes
from gridmill.llm.worker import lean

PLACE_BITS = np.uint64((1 << 24) - 1)


class Rule(NamedTuple):
    """Passages of ``min_words`` words or more; suffixes are compared by their first ``gram`` words."""

    min_words: int
    gram: int

    @property
    def reach(self) -> int:
        """How many words a stretch may begin before the place it is found by."""
        return self.min_words - self.gram


class Places(NamedTuple):
    """Minimiser places of many texts: word ``at``, found by the stretches from word ``low`` to ``high``."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def minimisers(words: Words, rule: Rule) -> Places:
    none = np.empty(0, np.int64)
    n = len(words.hash) - rule.min_words + 1
    if n < 1:
        return Places(none, none, none)
    grams = rolling_hashes(words.hash, rule.gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams & ~PLACE_BITS) | (place & PLACE_BITS)
    width, span = rule.reach + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    start = np.flatnonzero(words.doc[:n] == words.doc[rule.min_words - 1 :])
    if not len(start):
        return Places(none, none, none)
    at = start + ((least[start] - start.astype(np.uint64)) & PLACE_BITS).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return Places(at[first], start[first], start[last])


SUFFIXES = "doc_id bigint, text_key bigint, at int, head bigint, around bigint"


def _suffixes(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                words = split_words(part.column("text"))
                places = minimisers(words, rule)
                if not len(places.at):
                    continue
                first = np.concatenate([[0], np.cumsum(words.counts)])
                doc = words.doc[places.at]
                left, right = places.at - rule.reach, places.at + rule.min_words
                # A place too close to an end has a neighbourhood of its own.
                whole = (left >= first[doc]) & (right <= first[doc + 1])
                around = mix(mix(places.at.astype(np.uint64)) ^ part.column("text_key").to_numpy()[doc].view(np.uint64))
                wide = rolling_hashes(words.hash, rule.reach + rule.min_words)
                around[whole] = wide[left[whole]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)), part.column("text_key").take(pa.array(doc)),
                        pa.array((places.at - first[doc]).astype(np.int32)),
                        pa.array(rolling_hashes(words.hash, rule.gram)[places.at].view(np.int64)),
                        pa.array(around.view(np.int64)),
                    ],
                    ["doc_id", "text_key", "at", "head", "around"],
                )

    return run


MATCHED = "doc_id bigint, text_key bigint, at int, settled boolean, copied boolean, copy_of bigint"


def _same(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value equals the one before it; the first does not."""
    out = np.zeros(len(column), bool)
    values = column.to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.to_numpy()
    out[1:] = values[1:] == values[:-1]
    return out


def _once(table: pa.Table, *names: str) -> pa.Table:
    """Without rows that equal the row before in the named columns, as rows that were repeated give."""
    again = np.ones(table.num_rows, bool)
    for name in names:
        again &= _same(pc.fill_null(table.column(name), np.iinfo(np.int64).min if name == "doc_id" else 0))
    return table.filter(pa.array(~again)) if again.any() else table


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes, sorted, that share their head with a neighbour.

    At the ends of a partition the neighbour is not seen; such a suffix goes on unsettled, and the look-up
    of its stretches decides.
    """
    held = None  # the last row, whether it equals its neighbour before, and the first of its neighbourhood
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held[0], table]).combine_chunks()
        table = _once(table, "head", "around", "doc_id", "text_key", "at")
        head, around = _same(table.column("head")), _same(table.column("around"))
        around &= head
        lead = np.maximum.accumulate(np.where(around, 0, np.arange(len(head))))
        copy_of = table.column("doc_id").take(pa.array(lead))
        if held is None:
            head[0] = True
        else:
            head[0], around[0] = held[1], held[2]
            if held[2]:  # the neighbourhood began in an earlier batch
                end = int(np.argmin(np.append(around, False)))
                earlier = pa.array([held[3]] * end, pa.int64())
                copy_of = pa.chunked_array([earlier, copy_of.slice(end).combine_chunks()])
        later = np.append(head[1:], False)
        yield from _matched(table, head, later, around, copy_of, slice(0, len(head) - 1))
        held = (table.slice(len(head) - 1), bool(head[-1]), bool(around[-1]), copy_of[len(head) - 1].as_py())
    if held is not None:
        one = np.array([True])
        copy_of = pa.chunked_array([pa.array([held[3]], pa.int64())])
        yield from _matched(held[0], one, one, np.array([held[2]]), copy_of, slice(0, 1))


def _matched(table, before, later, around, copy_of, rows: slice) -> Iterator[pa.RecordBatch]:
    repeated = (before | later)[rows]
    settled = around[rows]
    copied = np.append(around[1:], False)[rows] | settled
    found = pa.Table.from_arrays(
        [
            *[table.column(c).slice(0, len(repeated)) for c in ("doc_id", "text_key", "at")],
            pa.array(settled), pa.array(copied), copy_of.slice(0, len(repeated)),
        ],
        ["doc_id", "text_key", "at", "settled", "copied", "copy_of"],
    )
    yield from found.filter(pa.array(repeated)).combine_chunks().to_batches()


STRETCHES = (
    "doc_id bigint, text_key bigint, low bigint, high bigint, start int, stop int, hash bigint, check bigint, "
    "copied boolean, copy_of bigint"
)


def _stretches(rule: Rule):
    """Stretches of the matched places, with code point offsets; settled places give one range without a hash."""

    def characters(data: np.ndarray, byte_at: np.ndarray) -> np.ndarray:
        """Code points before each byte place."""
        return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[byte_at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 500_000):
                words = split_words(part.column("text"))
                places = minimisers(words, rule)
                first = np.concatenate([[0], np.cumsum(words.counts)])
                data, at = text_bytes(part.column("text"))
                begin = characters(data, words.start + at[words.doc])
                end = characters(data, words.stop + at[words.doc])
                base = characters(data, at)
                lists = part.column("places")
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                place = flat.field("at").to_numpy() + first[doc]
                k = np.searchsorted(places.at, place)
                low, high = places.low[k], places.high[k]
                settled = flat.field("settled").to_numpy(zero_copy_only=False)
                size = np.where(settled, 1, high - low + 1)
                which = np.repeat(np.arange(len(k)), size)
                stop = np.cumsum(size)
                start = low[which] + np.arange(len(which)) - np.repeat(stop - size, size)
                last = np.where(settled[which], high[which], start)
                hashes = rolling_hashes(words.hash, rule.min_words)[start].view(np.int64)
                checks = rolling_hashes(second_hashes(words.hash), rule.min_words)[start].view(np.int64)
                own = doc[which]
                row = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(row), part.column("text_key").take(row),
                        pa.array(start - first[own]), pa.array(last - first[own]),
                        pa.array((begin[start] - base[own]).astype(np.int32)),
                        pa.array((end[last + rule.min_words - 1] - base[own]).astype(np.int32)),
                        pa.array(hashes, mask=settled[which]), pa.array(checks, mask=settled[which]),
                        flat.field("copied").take(pa.array(which)),
                        flat.field("copy_of").take(pa.array(which)),
                    ],
                    ["doc_id", "text_key", "low", "high", "start", "stop", "hash", "check", "copied", "copy_of"],
                )

    return run


RANGES = "doc_id bigint, text_key bigint, low bigint, high bigint, start int, stop int, kept boolean, copy_of bigint"


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, sorted by their two hashes, that occur again: the first keeps it, the others are copies of it."""
    held, said = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        table = _once(table, "hash", "check", "doc_id", "text_key", "low")
        # Two stretches are the same words if both of their hashes agree.
        same = _same(table.column("hash")) & _same(table.column("check"))
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        copied = table.column("copied").to_numpy()
        again = np.append(same[1:], False)
        out = same | again | (copied.astype(bool) & ~same)
        if held is not None and said:
            out[0] = False
        last = int(lead[-1])
        waits = bool(not out[last]) and not (held is not None and said and last == 0)
        columns = [table.column(c) for c in ("doc_id", "text_key", "low", "high", "start", "stop")]
        ids = table.column("doc_id").take(pa.array(lead))
        found = pa.Table.from_arrays([*columns, pa.array(~same), ids], RANGE_NAMES)
        yield from found.filter(pa.array(out)).combine_chunks().to_batches()
        held, said = table.slice(last, 1), not waits


RANGE_NAMES = [f.split()[0] for f in RANGES.split(", ")]


def repeated_passages(docs: DataFrame, min_words: int = 50, gram: int = 20) -> DataFrame:
    """Passages of ``min_words`` words or more that occur more than once, a row for each document's place.

    doc_id, text_key (hash of the text), start and stop (code points), n_words, kept and copy_of (a document
    that has the passage). Words are runs of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return, compared as they are; what lies between them has no say. The first place of
    a passage, by doc_id (null first), text and position, is kept, and so is one of passages inside one text.
    Removing all others leaves each repeated passage at one place. Rows that agree in doc_id and text count as one
    document. Shorter, empty and null texts have no passages; other columns are ignored.
    """
    rule = Rule(min_words, gram)
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    suffixes = scratch.store(texts.mapInArrow(lean(_suffixes(rule), "words"), SUFFIXES), "suffixes")
    order = ["head", "around", "doc_id", "text_key", "at"]
    # Ranges of the whole order split a head that very many suffixes share.
    sorted_suffixes = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    matched = scratch.store(sorted_suffixes.mapInArrow(lean(_neighbours, "words"), MATCHED), "matched")
    place = F.struct("at", "settled", "copied", "copy_of")
    by_text = matched.groupBy("doc_id", "text_key").agg(F.collect_set(place).alias("places"))
    likely = likely_rows(texts, matched.select("doc_id", "text_key").distinct())
    same = likely.doc_id.eqNullSafe(by_text.doc_id) & (likely.text_key == by_text.text_key)
    held = likely.join(by_text, same).select(likely.doc_id, likely.text_key, "text", "places")
    stretches = scratch.store(held.mapInArrow(lean(_stretches(rule), "words"), STRETCHES), "stretches")
    looked_up = (
        stretches.where("hash is not null").repartition("hash").sortWithinPartitions("hash", "check", "doc_id", "text_key", "low")
        .mapInArrow(lean(_look_up, "words"), RANGES)
    )
    settled = stretches.where("hash is null").select(
        "doc_id", "text_key", "low", "high", "start", "stop", F.lit(False).alias("kept"), "copy_of"
    )
    return _joined(looked_up.unionByName(settled), rule)


def _joined(ranges: DataFrame, rule: Rule) -> DataFrame:
    """Ranges of one text that overlap or touch, as passages."""
    own = Window.partitionBy("doc_id", "text_key", "kept").orderBy("low", "high")
    reached = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("low") > reached + rule.min_words, F.lit(True)).cast("int")
    numbered = ranges.withColumn("fresh", fresh).withColumn(
        "passage", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy("doc_id", "text_key", "kept", "passage")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            (F.max("high") - F.min("low") + rule.min_words).alias("n_words"), F.min("copy_of").alias("copy_of"),
        )
        .select("doc_id", "text_key", "start", "stop", "n_words", "kept", "copy_of")
    )


def _cut(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        parts.append(text[at : max(at, span["start"])])
        at = max(at, span["stop"])
    return "".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, min_words: int = 50, gram: int = 20) -> DataFrame:
    """``docs`` with all columns, without the passages that are copies; see ``repeated_passages``.

    A text of which nothing but white space is left goes; ``n_chars``, where there is such a column, follows
    the text. Documents without copies stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    found = scratch.store(repeated_passages(docs, min_words, gram).where("not kept"), "found")
    cuts = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    cuts = cuts.toDF("cut_id", "cut_key", "cuts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("document"), F.col("doc_id").cast("bigint").alias("cut_id_of"),
        F.xxhash64(text).alias("key_of"), text.alias("whole"),
    )
    # Only rows that may have cuts take part in the join; the texts of all others are not shuffled.
    marked = bit_map(F.xxhash64("doc_id", "text_key"), found.select("doc_id", "text_key").distinct())
    maybe, others = split_by_map(rows, F.xxhash64("cut_id_of", "key_of"), marked)
    same = F.col("cut_id_of").eqNullSafe(F.col("cut_id")) & (F.col("key_of") == F.col("cut_key"))
    joined = maybe.join(cuts, same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000, "whole"):
                left = [
                    None if cuts is None else _cut(text, cuts)
                    for text, cuts in zip(part.column("whole").to_pylist(), part.column("cuts").to_pylist())
                ]
                stays = [x is None or bool(x.strip(" \t\n\x0b\x0c\r")) for x in left]
                columns = [part.column("document"), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["document", "left"]).filter(pa.array(stays))

    document = joined.select("document", F.lit(None).cast("string").alias("left")).schema
    cut = joined.select("document", "whole", "cuts").mapInArrow(lean(run, "words"), document)
    cut = cut.unionByName(others.select("document", F.lit(None).cast("string").alias("left")))
    changed = {"text": F.coalesce("left", "document.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.isnull("left"), F.col("document.n_chars")).otherwise(F.char_length("left").cast(kind))
    return cut.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])
