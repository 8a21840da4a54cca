"""Language of texts, also of those that change it: scripts, word scores and a Viterbi pass.

A text is cut into words, runs of letters of one script. The script of a word leaves only the languages that
are written in it. Each of them has a score for the word, from how often its letter triples and the word
itself occur in texts of that language. The best path through the words of a text, where a change of
language costs a fixed penalty, labels spans; the language with the most letters in its spans is the text's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.pretokens import text_slices
from gridmill.llm.quality_fm import held_out
from gridmill.llm.vectors import sums_by_slot
from gridmill.llm.words import mix

#: The first code point of each range of a script, fixed values of the Unicode blocks; what is in none is "other".
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x0250, 0x02AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "sinhala": [(0x0D80, 0x0DFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "lao": [(0x0E80, 0x0EFF)],
    "tibetan": [(0x0F00, 0x0FFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
    "other": [],
}
#: Triples of letters and whole words are counted in so many buckets each.
BUCKETS = 1 << 15
#: What a change of language costs, in units of a word's score (natural logarithms).
PENALTY = 10.0
#: A script is one of a language if it has this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTH = 0.5


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (2 * BUCKETS, languages): log of the frequency over its mean
    allowed: np.ndarray  # (scripts, languages)


class Words(NamedTuple):
    """Words in order: their row, places of code points in the text, letters and script, and their features."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    script: np.ndarray
    triple: np.ndarray  # buckets, one per letter
    first: np.ndarray  # each word's first place in ``triple``
    whole: np.ndarray  # bucket of each word
    counts: np.ndarray  # words per row


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script (0: no letter, -1: a mark that goes with the letter before it), and its small letter."""
    points = range(0x110000)
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in points], np.uint8)
    script = np.full(len(points), len(SCRIPTS), np.int8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            script[lo : hi + 1] = number
    script[kinds == ord("M")] = -1
    script[(kinds != ord("L")) & (kinds != ord("M"))] = 0
    small = np.arange(len(points), dtype=np.uint32)
    for c in np.flatnonzero(kinds == ord("L")).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            small[c] = ord(low)
    return script, small


def split_letters(texts: list[str]) -> Words:
    """The words of all texts: maximal runs of letters of one script, with the marks that follow them."""
    script_of, small = letter_tables()
    # One separator after each text; it is no letter.
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    script = script_of[points]
    marks = np.flatnonzero(script < 0)
    if len(marks):
        known = np.where(script < 0, 0, np.arange(len(script)))
        script[marks] = script[np.maximum.accumulate(known)[marks]]
        script = np.maximum(script, 0)
    change = np.flatnonzero(np.diff(script)) + 1
    start = np.concatenate([[0], change])[: len(change) + 1]
    stop = np.concatenate([change, [len(script)]])
    inside = script[start] > 0 if len(script) else np.zeros(len(start), bool)
    start, stop = start[inside], stop[inside]
    doc = np.searchsorted(at, start, "right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    # Letters of all words with one zero before each: every letter has a left and a right neighbour.
    size = stop - start
    first = np.cumsum(size) - size
    here = np.arange(int(size.sum())) + np.repeat(start - first, size)
    letters = np.zeros(len(here) + len(start) + 1, np.uint64)
    place = np.arange(len(here)) + np.repeat(np.arange(1, len(start) + 1), size)
    letters[place] = small[points[here]] + 1
    left, mid, right = letters[place - 1], letters[place], letters[place + 1]
    triple = mix((left << np.uint64(42)) | (mid << np.uint64(21)) | right)
    # A word is the sum of its letters' triples, each turned by its place from the start.
    turned = mix(triple + (np.arange(len(here)) - np.repeat(first, size)).astype(np.uint64))
    whole = np.add.reduceat(turned, first) if len(first) else np.empty(0, np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return Words(
        doc, start - at[doc], stop - at[doc], script[start] - 1, (triple >> shift).astype(np.int64), first,
        BUCKETS + (mix(whole) >> shift).astype(np.int64), counts,
    )


def count_features(texts: list[str]) -> np.ndarray:
    """How often each bucket of triples and words and, behind them, each script's letters occur."""
    words = split_letters(texts)
    out = np.bincount(np.concatenate([words.triple, words.whole]), minlength=2 * BUCKETS + len(SCRIPTS))
    out[2 * BUCKETS :] += np.bincount(words.script, words.stop - words.start, minlength=len(SCRIPTS)).astype(np.int64)
    return out


def model_from_counts(counts: dict[str, np.ndarray]) -> Model:
    """The scores of all languages from their counts; the same for any order of the texts."""
    languages = sorted(lang for lang, c in counts.items() if c[: 2 * BUCKETS].any())
    if not languages:
        return Model([], np.empty((2 * BUCKETS, 0), np.float32), np.empty((len(SCRIPTS), 0), bool))
    table = np.array([counts[lang] for lang in languages], float)
    logs = []
    for lo in (0, BUCKETS):
        part = table[:, lo : lo + BUCKETS] + SMOOTH
        part = np.log(part / part.sum(1, keepdims=True))
        logs.append(part - part.mean(0))
    scripts = table[:, 2 * BUCKETS :]
    allowed = (scripts >= SCRIPT_SHARE * scripts.sum(1, keepdims=True)) & (scripts > 0)
    allowed = allowed.T.copy()
    allowed[~allowed.any(1)] = True  # nobody writes in it: any language may be meant
    return Model(languages, np.concatenate(logs, axis=1).T.astype(np.float32), allowed)


def fit(docs: DataFrame, most_languages: int = 1000) -> Model:
    """Counts of all documents that are not held out and have a language, by language.

    Held out are those whose crc32 of the id as text leaves 1 when divided by 3. Every task adds up its own
    counts, so a language with a third of all rows sends one row per task and bucket. The model has 65,536
    numbers per language; ``most_languages``, the most frequent ones, bounds it. Rows without text or
    language teach nothing; without any others the model knows no language.
    """
    known = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).select("text", "lang")
    order = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    languages = [r.lang for r in order.collect()]
    place = {lang: i for i, lang in enumerate(languages)}
    width = 2 * BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                by_language: dict[int, list[str]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    if lang in place:
                        by_language.setdefault(place[lang], []).append(text)
                for i, texts in by_language.items():
                    if i not in totals:
                        totals[i] = np.zeros(width, np.int64)
                    totals[i] += count_features(texts)
        for i, sums in totals.items():
            found = sums_by_slot(sums)
            slot = pa.array(found.column("slot").to_numpy() + i * width)
            yield pa.RecordBatch.from_arrays([slot, found.column("value")], ["slot", "value"])

    # Bounded by the model's own size: buckets times languages.
    sums = known.mapInArrow(count, "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    table = np.zeros(width * len(languages), np.int64)
    table[sums.column("slot").to_numpy()] = sums.column("value").to_numpy()
    return model_from_counts(dict(zip(languages, table.reshape(-1, width))))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(word, language): the sum of the scores of the word's triples and the word; -inf for other scripts."""
    out = np.add.reduceat(model.scores[words.triple], words.first, axis=0) if len(words.first) else np.empty((0, len(model.languages)))
    out = out + model.scores[words.whole]
    return np.where(model.allowed[words.script], out, -np.inf)


def best_path(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word: per row of ``counts`` words, the path with the largest sum of scores less penalties.

    Ties go to staying in a language, then to the first language. All rows take their steps together.
    A word that no language of its neighbours is written in moves the path, whatever that costs.
    """
    n_rows, (n, k) = len(counts), scores.shape
    if k <= 1:
        return np.zeros(n, np.int64)
    # Finite, so that a path through words of different scripts has a sum.
    scores = np.maximum(scores, -1e6)
    ends = np.cumsum(counts)
    order = np.argsort(-counts, kind="stable")
    begin = (ends - counts)[order]
    active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")
    stays = np.empty((n, k), bool)
    best_before = np.zeros(n, np.int64)
    value = np.zeros((n_rows, k))
    for step, rows in enumerate(active.tolist()):
        at = begin[:rows] + step
        now = value[:rows]
        if step:
            best = now.argmax(1)
            leave = now[np.arange(rows), best][:, None] - penalty
            stays[at] = now >= leave
            best_before[at] = best
            np.maximum(now, leave, out=now)
        now += scores[at]
    out = np.empty(n, np.int64)
    state = value.argmax(1)
    for step in range(len(active) - 1, -1, -1):
        rows = active[step]
        at = begin[:rows] + step
        here = state[:rows]
        out[at] = here
        if step:
            state[:rows] = np.where(stays[at, here], here, best_before[at])
    return out


def constant_rows(scores: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows surely keep one language throughout, and which language it is.

    If no run of words gains half a penalty or more in any other language, no change can pay: a path with m
    runs in other languages changes at least m times, or m - 1 times if nothing is left of the first language,
    and then it has two runs or more, or one whose sum over the whole text is not larger.
    """
    n_rows, k = len(counts), scores.shape[1]
    ends = np.cumsum(counts)
    begin = ends - counts
    sums = np.zeros((n_rows, k))
    filled = counts > 0
    finite = np.maximum(scores, -1e6)
    if filled.any():
        sums[filled] = np.add.reduceat(finite, begin[filled], axis=0)
    best = sums.argmax(1)
    sure = np.ones(n_rows, bool)
    for row in np.flatnonzero(filled).tolist():
        mine = finite[begin[row] : ends[row]]
        gain = np.cumsum(mine - mine[:, best[row], None], axis=0)
        lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        sure[row] = (gain[1:] - lowest[:-1]).max(initial=gain[0].max()) < penalty / 2 and gain[0].max() < penalty / 2
    return sure, best


class Labels(NamedTuple):
    language: np.ndarray  # of each row, -1: none
    score: np.ndarray
    spans: list[list[tuple[int, int, int]]]  # start, stop (code points), language


def label(texts: list[str], model: Model, penalty: float = PENALTY, with_spans: bool = False) -> Labels:
    """Language, score and spans of texts. The score is the share of the letters that lie in spans of the
    language, times its probability against the other languages over the words of those spans."""
    words = split_letters(texts)
    n, k = len(texts), len(model.languages)
    if not k:
        return Labels(np.full(n, -1), np.zeros(n), [[] for _ in texts])
    scores = word_scores(words, model)
    sure, constant = constant_rows(scores, words.counts, penalty)
    path = constant[words.doc]
    open_words = ~sure[words.doc]
    path[open_words] = best_path(scores[open_words], words.counts[~sure], penalty)
    letters = (words.stop - words.start).astype(float)
    share = np.bincount(words.doc * k + path, letters, minlength=n * k).reshape(n, k)
    total = share.sum(1)
    language = np.where(total > 0, share.argmax(1), -1)
    mine = path == language[words.doc]
    sums = np.zeros((n, k))
    own = np.maximum(scores, -1e6)
    for j in range(k):
        sums[:, j] = np.bincount(words.doc[mine], own[mine, j], minlength=n)
    top = sums[np.arange(n), np.maximum(language, 0)][:, None]
    odds = np.exp(np.clip(sums - top, -700, 700)).sum(1)
    score = np.where(total > 0, share.max(1) / np.maximum(total, 1) / odds, 0.0)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if with_spans:
        change = np.flatnonzero((np.diff(words.doc) != 0) | (np.diff(path) != 0)) + 1
        for lo, hi in zip([0, *change], [*change, len(path)]):
            if hi > lo:
                spans[words.doc[lo]].append((int(words.start[lo]), int(words.stop[hi - 1]), int(path[lo])))
    return Labels(language, np.clip(score, 0, 1), spans)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and spans (start, stop, lang; places of code points) of every document.

    Only the text is looked at. ``und`` with score 0 and no spans: a null text, one without letters, or a
    model without languages. Whole texts of any length; equal rows give equal rows; other columns are ignored.
    """
    names = np.array([*model.languages, "und"], object)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = label(part.column("text").to_pylist(), model, penalty, with_spans)
                columns = [
                    part.column("doc_id"), pa.array(names[found.language], pa.string()), pa.array(found.score, pa.float64())
                ]
                if with_spans:
                    spans = [[{"start": a, "stop": b, "lang": names[i]} for a, b, i in row] for row in found.spans]
                    columns.append(pa.array(spans, span_type))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, lang_pred string, score double"
    return texts.mapInArrow(run, schema + (", spans array<struct<start:int,stop:int,lang:string>>" if with_spans else ""))
