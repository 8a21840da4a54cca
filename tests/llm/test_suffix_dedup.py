"""Repeated passages against all stretches of all texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridmill.llm import suffix_dedup as sd
from gridmill.llm.words import split_words

from .cases import DOCS, TEXTS, awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    """Code points of kept and of copied repeated stretches, as sets of (doc, place of a word)."""
    words = [[(m.group(), m.start(), m.end()) for m in WORD.finditer(t or "")] for t in texts]
    seen = {}
    for doc, own in enumerate(words):
        for s in range(len(own) - length + 1):
            seen.setdefault(tuple(w for w, _, _ in own[s : s + length]), []).append((doc, s))
    kept, copies = set(), set()
    for places in seen.values():
        if len(places) > 1:
            for k, (doc, s) in enumerate(places):
                (copies if k else kept).update((doc, own[1]) for own in words[doc][s : s + length])
    return kept, copies


def found(rows, texts):
    kept, copies = set(), set()
    for r in rows:
        text = texts[r.doc_id]
        inside = [m.start() for m in WORD.finditer(text) if r.start <= m.start() < r.stop]
        assert len(inside) == r.n_words and not text[r.start].isspace() and not text[r.stop - 1].isspace()
        (kept if r.kept else copies).update((r.doc_id, p) for p in inside)
    return kept, copies


def corpus(seed, size=80):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["é", "a", "bb", "日", "c"]) + str(rnd.randrange(60))
    passages = [[word() for _ in range(rnd.choice([6, 8, 9, 15, 40]))] for _ in range(12)]
    texts = []
    for _ in range(size):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += [word() for _ in range(rnd.randint(0, 25))] + rnd.choice(passages) * rnd.choice([1, 1, 1, 2])
        texts.append("".join(w + rnd.choice([" ", "\n", "  "]) for w in words))
        if rnd.random() < 0.2:
            texts.append(rnd.choice(texts))
    texts += [" ".join(passages[-1])] * 30
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = documents(spark, texts).repartition(4)
    rows = sd.repeated_passages(docs, min_words=8, gram=3 if seed % 2 else 5).collect()
    assert found(rows, texts) == brute(texts, 8)
    assert all(r.copy_of is not None for r in rows)


def test_production_lengths(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(55)]
    texts = [" ".join([word() for _ in range(rnd.randint(0, 300))]) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] += " " + "\n".join(passage) + " " + " ".join(word() for _ in range(40))
    texts[7] = " ".join(passage[:49])
    rows = sd.repeated_passages(documents(spark, texts)).collect()
    assert found(rows, texts) == brute(texts, 50)
    assert {r.doc_id for r in rows} == set(range(0, 60, 3))


def test_minimisers_cover_every_stretch():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    words = split_words(pa.array(texts))
    for rule in (sd.Rule(8, 3), sd.Rule(9, 2), sd.Rule(5, 5)):
        places = sd.minimisers(words, rule)
        starts = np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(places.low, places.high)] or [np.empty(0, int)])
        n = np.concatenate([[0], np.cumsum(words.counts)])
        want = [s for lo, hi in zip(n[:-1], n[1:]) for s in range(lo, hi - rule.min_words + 1)]
        assert starts.tolist() == want
        assert all(lo <= at <= lo + rule.reach for lo, at in zip(places.low, places.at))


def test_removal_keeps_one_of_each(spark):
    texts = corpus(9)
    left = sd.remove_repeats(documents(spark, texts), min_words=8, gram=3)
    assert left.columns == documents(spark, []).columns
    rows = left.collect()
    _, copies = brute(texts, 8)
    want = {}
    for i, text in enumerate(texts):
        want[i] = [m.group() for m in WORD.finditer(text) if (i, m.start()) not in copies]
    got = {r.doc_id: WORD.findall(r.text) for r in rows}
    touched = {d for d, _ in copies}
    assert got == {i: w for i, w in want.items() if w or i not in touched}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_awkward_texts(spark):
    rows = sd.remove_repeats(awkward(spark)).collect()
    texts = sorted((r.text or "") for r in rows)
    long = [t for t in TEXTS if t and len(WORD.findall(t)) >= 100]
    assert len(rows) == len(TEXTS) + 4 and len(long) == 1
    assert sum(len(WORD.findall(t)) for t in texts if t.startswith("word")) < len(WORD.findall(long[0]))
    assert sd.repeated_passages(empty(spark)).count() == 0 and sd.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x"), (None, text + " y")], "doc_id bigint, text string")
    rows = sd.repeated_passages(docs).collect()
    assert sorted((r.doc_id or 0, r.kept, r.n_words) for r in rows) == [(0, True, 90), (1, False, 90)]
    left = sd.remove_repeats(docs.where("doc_id = 1"))
    assert [r.text for r in left.collect()] == [text, text]
