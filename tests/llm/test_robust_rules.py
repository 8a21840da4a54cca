"""Base counts against brute force; the verdict on planted outliers."""

import random
import re
from collections import Counter
from statistics import NormalDist

import pytest

from gridmill.llm.robust_rules import base_statistics, chi_square_quantile, consistency, robust_rules

from .cases import DOCS, TEXTS, awkward, documents, empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_texts():
    rnd = random.Random(1)
    for _ in range(150):
        words = [rnd.choice("abc") for _ in range(rnd.randint(0, 60))]
        yield "".join(w + rnd.choice([" ", "  ", "\n", "\t"]) for w in words)
    yield "one two three four five six seven eight nine\n" * 40
    yield "a " * 500


def test_base_counts(spark):
    texts = [*TEXTS, *repeated_texts()]
    rows = base_statistics(documents(spark, texts)).select("doc_id", *COUNTS).collect()
    assert {tuple(r) for r in rows} == {(i, *brute(t)) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def clean():
    rnd = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    return [" ".join(word() for _ in range(rnd.randint(20, 300))) + "." for _ in range(400)]


def test_outliers_go_and_clean_documents_stay(spark, clean):
    long = [t for t in clean if t.count(" ") > 100]
    bad = [" ".join(w + "***" for w in t.split()) for t in long[:20]] + [t.upper() for t in long[20:40]]
    rows = [(i, t, "en", "a" if i % 3 else "b", 0) for i, t in enumerate(clean + bad)]
    rows += [(1000 + i, t, "de", f"tiny{i}", 0) for i, t in enumerate(clean[:30])]
    result = {r.doc_id: r for r in robust_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(result) == len(rows)
    assert all(result[i].kept for i in range(len(clean)))
    assert not any(result[i].kept for i in range(len(clean), len(clean) + len(bad)))
    assert all(result[1000 + i].kept for i in range(30))


def starred(text, every=1):
    return " ".join(w + "***" if i % every == 0 else w for i, w in enumerate(text.split()))


@pytest.mark.parametrize("percent", [30, 40])
def test_much_junk_goes(spark, clean, percent):
    long = [t for t in clean if t.count(" ") > 100]
    n = len(clean) * percent // (100 - percent)
    bad = [starred(long[i % len(long)], 1 + i % 3) for i in range(n)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(clean + bad)]
    kept = {r.doc_id for r in robust_rules(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(len(clean)))


@pytest.mark.parametrize("junk", [True, False])
def test_copies_of_one_text_do_not_move_the_fit(spark, clean, junk):
    long = next(t for t in clean if t.count(" ") > 250)
    copies = [starred(long, 2) if junk else long] * (len(clean) // 2)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(clean + copies)]
    kept = {r.doc_id for r in robust_rules(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(len(clean) if junk else len(rows)))


def test_short_and_monotonous_texts_go(spark, clean):
    rnd = random.Random(4)
    words = [t.split() for t in clean if t.count(" ") > 100]
    piped = [" ".join(w + " |" if i % 2 else w for i, w in enumerate(ws[: rnd.randint(50, 65)])) for ws in words[:20]]
    few = [" ".join(rnd.choices(ws[:4], k=100)) for ws in words[20:40]]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(clean + piped + few)]
    result = robust_rules(spark.createDataFrame(rows, DOCS)).where("not base_failed").collect()
    assert sum(r.doc_id >= len(clean) for r in result) >= 30
    assert {r.doc_id for r in result if r.kept} == set(range(len(clean)))


def test_pairs_of_one_word(spark):
    texts = [*TEXTS, *repeated_texts()]
    rows = base_statistics(documents(spark, texts)).select("doc_id", "n_word_pairs").collect()
    pairs = lambda t: sum(n * (n - 1) // 2 for n in Counter(WORDS.findall(t or "")).values())
    assert {tuple(r) for r in rows} == {(i, pairs(t)) for i, t in enumerate(texts)}


def test_awkward_documents(spark):
    rows = robust_rules(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 4
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert robust_rules(empty(spark)).count() == 0


def test_chi_square():
    assert chi_square_quantile(0.999, 5) == pytest.approx(20.515, abs=1e-3)
    assert chi_square_quantile(0.5, 6) == pytest.approx(5.348, abs=1e-3)
    q = NormalDist().inv_cdf(0.75)
    inner_variance = 1 - 4 * q * NormalDist().pdf(q)  # of a normal variable between its quartiles
    assert consistency(1, 5) == 1 and consistency(0.5, 1) == pytest.approx(1 / inner_variance, rel=1e-6)
