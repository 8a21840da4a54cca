"""Language ID: the path against plain search, held-out accuracy, spans of mixed texts, scripts, awkward input."""

import itertools
import random
import zlib

import numpy as np
import pytest

from gridmill.llm import language_id as li

from .cases import DOCS, TEXTS, awkward, empty

PARTS = {
    "en": ["th", "er", "on", "an", "re", "wh", "ing"],
    "es": ["que", "ión", "lla", "ado", "ñe", "ci"],
    "ru": ["ов", "ни", "ст", "ра", "ть", "ко"],
    "uk": ["їв", "ни", "ст", "ра", "ґі", "є"],
}


def words(rnd, lang, n):
    return ["".join(rnd.choices(PARTS[lang], k=rnd.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(600):
        lang = rnd.choice(list(PARTS))
        text = " ".join(words(rnd, lang, rnd.randint(3, 60))).capitalize() + ".\n"
        docs.append((i, text, lang if i % 7 else None, "s", lang))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, truth string")


@pytest.fixture(scope="module")
def model(corpus):
    return li.fit(corpus)


def test_held_out_accuracy(corpus, model):
    assert model.languages == sorted(PARTS)
    found = li.identify(corpus, model).join(corpus.select("doc_id", "truth"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(found) == 600 and np.mean([r.lang_pred == r.truth for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_counts_equal_a_plain_count(corpus, model):
    counts = {}
    for r in corpus.collect():
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang] = counts.get(r.lang, 0) + li.count_features([r.text])
    again = li.model_from_counts(counts)
    assert np.array_equal(again.scores, model.scores) and np.array_equal(again.allowed, model.allowed)


def test_held_out_and_other_columns_have_no_say(spark, corpus, model):
    other = corpus.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'no word', text) text", "lang", "'t' source"
    )
    assert np.array_equal(li.fit(other.repartition(7)).scores, model.scores)


def test_spans_of_mixed_texts(model):
    rnd = random.Random(9)
    right = total = 0
    for _ in range(40):
        order = rnd.sample(["en", "es", "uk"], 3)
        pieces = [" ".join(words(rnd, lang, 25)) for lang in order]
        text = ". ".join(pieces)
        spans = li.label([text], model, with_spans=True).spans[0]
        truth = "".join(f"{i}" * len(p) + " " * 2 for i, p in enumerate(pieces))
        for start, stop, lang in spans:
            for c, t in zip(text[start:stop], truth[start:stop]):
                if c.isalpha():
                    total += 1
                    right += t != " " and order[int(t)] == model.languages[lang]
        assert "".join(c for s, e, _ in spans for c in text[s:e] if c.isalpha()) == "".join(c for c in text if c.isalpha())
    assert right / total > 0.97


def test_best_path_equals_the_best_of_all_paths():
    rnd = np.random.default_rng(2)
    counts = np.array([4, 0, 1, 6, 3])
    for penalty in (0.5, 2.0, 8.0):
        scores = rnd.normal(size=(counts.sum(), 3)) * 2
        scores[rnd.random(scores.shape) < 0.1] = -np.inf
        scores[np.isinf(scores).all(1)] = 0
        path = li.best_path(scores, counts, penalty)
        finite = np.maximum(scores, -1e6)
        sure, constant = li.constant_rows(scores, counts, penalty)
        begin = 0
        for row, n in enumerate(counts):
            mine = finite[begin : begin + n]

            def worth(p, mine=mine):
                return sum(mine[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))

            best = max(map(worth, itertools.product(range(3), repeat=int(n))))
            assert worth(path[begin : begin + n]) == pytest.approx(best)
            if sure[row]:
                assert worth([constant[row]] * n) == pytest.approx(best)
            begin += n


def test_certain_rows_are_left_to_the_path_where_a_change_pays():
    scores = np.array([[9.0, 0.0]] * 3 + [[0.0, 9.0]] * 3 + [[1.0, 0.0]] * 4)
    sure, best = li.constant_rows(scores, np.array([6, 4]), 10.0)
    assert sure.tolist() == [False, True] and best[1] == 0
    assert li.best_path(scores, np.array([6, 4]), 10.0).tolist() == [0, 0, 0, 1, 1, 1, 0, 0, 0, 0]


def test_scripts_narrow_the_languages(model):
    found = li.label(["ни ст ра", "xyz", "日本語", "ни th ст er ра an", "ї"], model, with_spans=True)
    names = [model.languages[i] for i in found.language]
    assert names[0] in ("ru", "uk") and names[1] in ("en", "es") and names[2] in PARTS and names[4] == "uk"
    latin = list(li.SCRIPTS).index("latin")
    assert [lang for lang, ok in zip(model.languages, model.allowed[latin]) if ok] == ["en", "es"]


def test_words_are_runs_of_letters_of_one_script():
    texts = ["Été l'an 2x", "", "абвgд", "नमस्ते दुनिया", " \n", "áb ́c", "ab"]
    found = li.split_letters(texts)
    got = [texts[d][a:b] for d, a, b in zip(found.doc, found.start, found.stop)]
    assert got == ["Été", "l", "an", "x", "абв", "g", "д", "नमस्ते", "दुनिया", "áb", "c", "ab"]
    assert found.counts.tolist() == [4, 0, 3, 2, 0, 2, 1]
    one, two = li.split_letters(["Then THEN then"]), li.split_letters(["net neth"])
    assert len(set(one.whole)) == 1 and len(set(two.whole)) == 2


def test_awkward_documents(spark, model):
    found = li.identify(awkward(spark), model)
    assert found.columns == ["doc_id", "lang_pred", "score", "spans"]
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(TEXTS) + 4
    for i, text in enumerate(TEXTS):
        none = not any(c.isalpha() for c in text or "")
        assert (rows[i].lang_pred == "und") == none and (rows[i].score > 0) != none
    assert li.identify(empty(spark), model).count() == 0


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(0, "some text", None, "s", 1), (1, None, "en", "s", 1), (2, "12", "en", "s", 1)], DOCS)
    for few in (docs, docs.where("false")):
        model = li.fit(few)
        assert {(r.lang_pred, r.score) for r in li.identify(docs, model).collect()} == {("und", 0.0)}
    one = li.fit(spark.createDataFrame([(0, "some text", "en", "s", 1)], DOCS))
    assert [r.lang_pred for r in li.identify(docs, one).orderBy("doc_id").collect()] == ["en", "und", "und"]


def test_very_long_text(model):
    rnd = random.Random(1)
    text = " ".join(words(rnd, "en", 60_000) + words(rnd, "es", 40_000))
    found = li.label([text, "12"], model, with_spans=True)
    assert model.languages[found.language[0]] == "en" and len(found.spans[0]) == 2
