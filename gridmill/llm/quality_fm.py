"""A quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; each pair of features adds the product of their values and
the inner product of their vectors. The sum over all pairs is half the difference of the squared sum and
the sum of squares of the vectors, so a text is scored in time linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.pretokens import text_slices
from gridmill.llm.words import hash_ranges, split_words, text_bytes
from gridmill.llm.worker import lean

WORD_BUCKETS = 1 << 14
RANK = 4
STATISTICS = [
    "no_words", "length", "word_length", "capitals", "digits", "symbols", "bangs", "points", "other_bytes",
    "lines", "word_share", "next_pairs", "line_share", "recorded_length", "no_record",
]
FEATURES = WORD_BUCKETS + len(STATISTICS)


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


class Rows(NamedTuple):
    """Sparse rows: the features of row i are ``index[ends[i-1]:ends[i]]`` with ``value`` alike."""

    ends: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _class(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(symbols)] = 1
    return table


CLASSES = {
    "capitals": _class(bytes(range(65, 91))),
    "digits": _class(b"0123456789"),
    "symbols": _class(b"#*$%&|<>@^~=+{}[]\\/_"),
    "bangs": _class(b"!?"),
    "points": _class(b".,;:"),
    "other_bytes": _class(bytes(range(128, 256))),
    "lines": _class(b"\n"),
}


def _repeat_share(doc: np.ndarray, keys: np.ndarray, n_docs: int) -> np.ndarray:
    """The share of the values of each row that occur earlier in it."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    again = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    return np.bincount(d[1:][again], minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of every line, in order, and a hash of its bytes; what follows the last line feed is a line, too."""
    newline = np.flatnonzero(data == 10)
    open_end = np.flatnonzero(at[1:] > at[:-1])
    open_end = open_end[data[at[open_end + 1] - 1] != 10]
    doc = np.concatenate([np.searchsorted(at, newline, "right") - 1, open_end])
    stop = np.concatenate([newline, at[open_end + 1]])
    order = np.lexsort((stop, doc))
    doc, stop = doc[order], stop[order]
    start = at[doc]
    same = doc[1:] == doc[:-1]
    start[1:][same] = stop[:-1][same] + 1
    return doc, hash_ranges(data, start, stop, lower=False)


def features(texts: pa.StringArray, recorded: np.ndarray) -> Rows:
    """Features of whole texts; ``recorded`` is the column n_chars, NaN where it is null."""
    n = len(texts)
    words = split_words(texts, lower=True)
    data, at = text_bytes(texts)
    n_words = words.counts
    n_bytes = np.maximum(at[1:] - at[:-1], 1)

    bucket = (words.hash >> np.uint64(50)).astype(np.int64)
    keys, tf = np.unique(words.doc * WORD_BUCKETS + bucket, return_counts=True)
    word_doc, word_index = keys // WORD_BUCKETS, keys % WORD_BUCKETS
    weight = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(word_doc, weight**2, minlength=n))
    word_value = weight / norm[word_doc]

    per_byte = {}
    for name, table in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[data])])
        per_byte[name] = (sums[at[1:]] - sums[at[:-1]]) / n_bytes
    same_doc = words.doc[1:] == words.doc[:-1]
    pair = (words.hash[1:] * np.uint64(3) + words.hash[:-1])[same_doc]
    line_doc, line_key = _lines(data, at)
    known = ~np.isnan(recorded)
    stats = {
        "no_words": (n_words == 0).astype(float),
        "length": np.log1p(n_words) / 5,
        "word_length": np.log1p(np.bincount(words.doc, words.stop - words.start, minlength=n) / np.maximum(n_words, 1)),
        **{name: np.log1p(20 * share) for name, share in per_byte.items()},
        "word_share": _repeat_share(words.doc, words.hash, n),
        "next_pairs": 2 * _repeat_share(words.doc[1:][same_doc], pair, n),
        "line_share": _repeat_share(line_doc, line_key, n),
        "recorded_length": np.log1p(np.where(known, np.maximum(recorded, 0), 0)) / 10,
        "no_record": (~known).astype(float),
    }
    stat_value = np.stack([stats[name] for name in STATISTICS], axis=1)

    doc = np.concatenate([word_doc, np.repeat(np.arange(n), len(STATISTICS))])
    index = np.concatenate([word_index, np.tile(WORD_BUCKETS + np.arange(len(STATISTICS)), n)])
    value = np.concatenate([word_value, stat_value.ravel()])
    order = np.argsort(doc, kind="stable")
    return Rows(np.cumsum(np.bincount(doc, minlength=n)), index[order].astype(np.int32), value[order].astype(np.float32))


def raw_scores(rows: Rows, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for every row and the summed vectors, by the sum-of-squares identity."""
    starts = np.concatenate([[0], rows.ends[:-1]])  # no row is empty: the statistics are always there
    value = rows.value[:, None]
    scaled = model.vectors[rows.index] * value
    sums = np.add.reduceat(scaled, starts, axis=0)
    squares = np.add.reduceat((scaled**2).sum(1), starts)
    linear = np.add.reduceat(model.weights[rows.index] * rows.value, starts)
    return model.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def train(rows: Rows, labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Logistic loss, adaptive steps, fixed seed; both classes weigh the same."""
    rnd = np.random.default_rng(7)
    weights = np.zeros(FEATURES, np.float32)
    vectors = rnd.normal(0, 0.01, (FEATURES, RANK)).astype(np.float32)
    bias, n = 0.0, len(labels)
    if not n or labels.min() == labels.max():
        return Model(0.0 if not n else float(4 * labels[0] - 2), weights, np.zeros_like(vectors))
    grade = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
    starts = np.concatenate([[0], rows.ends[:-1]])
    for _ in range(epochs):
        for own in np.array_split(rnd.permutation(n), max(1, n // batch)):
            sizes = rows.ends[own] - starts[own]
            ends = np.cumsum(sizes)
            pick = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - sizes), sizes)
            part = Rows(ends, rows.index[pick], rows.value[pick])
            score, sums = raw_scores(part, Model(bias, weights, vectors))
            slope = grade[own] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[own]) / len(own)
            each = np.repeat(slope, sizes) * part.value
            index, where = np.unique(part.index, return_inverse=True)
            grad_w = np.bincount(where, each) + decay * weights[index]
            pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - vectors[part.index] * part.value[:, None])
            grad_v = np.stack([np.bincount(where, pull[:, f]) for f in range(RANK)], axis=1) + decay * vectors[index]
            seen_w[index] += grad_w**2
            seen_v[index] += grad_v**2
            seen_b += slope.sum() ** 2
            weights[index] -= rate * grad_w / np.sqrt(seen_w[index])
            vectors[index] -= 0.3 * rate * grad_v / np.sqrt(seen_v[index])
            bias -= rate * slope.sum() / np.sqrt(seen_b)
    return Model(float(bias), weights, vectors)


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        recorded.alias("recorded"), *more,
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by the CRC-32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Model:
    """Train on at most ``max_rows`` labelled documents, the first by the hash of their id.

    The bound is for the fit alone: at most ``max_rows`` sparse rows reach the driver. Held-out documents, null
    labels and labels of unknown documents are not used; of several labels of a document the lowest counts.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                recorded = part.column("recorded").to_numpy(zero_copy_only=False).astype(float)
                rows = features(part.column("text"), recorded)
                ends = pa.array(np.concatenate([[0], rows.ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("label"),
                        pa.ListArray.from_arrays(ends, pa.array(rows.index)),
                        pa.ListArray.from_arrays(ends, pa.array(rows.value)),
                    ],
                    ["doc_id", "label", "index", "value"],
                )

    # Bounded: at most ``max_rows`` ids.
    texts = _texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "recorded", "label")
    table = texts.mapInArrow(lean(sparse), "doc_id bigint, label int, index array<int>, value array<float>").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return train(Rows(np.empty(0, int), np.empty(0, np.int32), np.empty(0, np.float32)), np.empty(0))
    lists = {name: table.column(name).combine_chunks() for name in ("index", "value")}
    ends = np.cumsum(np.array([len(x) for x in lists["index"]]))
    rows = Rows(ends, lists["index"].flatten().to_numpy(), lists["value"].flatten().to_numpy())
    return train(rows, table.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher for better) and predicted (1 from 0.5 on) of every document.

    Only the text and ``n_chars`` are looked at; a null text counts as empty and has a score, too; equal rows
    get equal scores; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                recorded = part.column("recorded").to_numpy(zero_copy_only=False).astype(float)
                raw, _ = raw_scores(features(part.column("text"), recorded), model)
                probability = 1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(probability), pa.array((probability >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    scored = _texts(docs).mapInArrow(lean(run), "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with all their columns that the model does not reject."""
    # The text is taken out of the document in the task, so that it is sent to Python once.
    place = [c.lower() for c in docs.columns].index("text")
    inside = docs.select(
        F.struct("*").alias("document"),
        (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("recorded"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("document").field(place), "")
            columns = [batch.column("document"), text, batch.column("recorded")]
            for part in text_slices(pa.RecordBatch.from_arrays(columns, ["document", "text", "recorded"]), 1_000_000):
                recorded = part.column("recorded").to_numpy(zero_copy_only=False).astype(float)
                raw, _ = raw_scores(features(part.column("text"), recorded), model)
                good = pa.RecordBatch.from_arrays([part.column("document")], ["document"]).filter(pa.array(raw >= 0))
                if good.num_rows:
                    yield good

    kept = inside.mapInArrow(lean(run), inside.select("document").schema)
    return kept.select("document.*")
