"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridmill.llm import jaccard_join as jj
from gridmill.llm.words import split_words

from .cases import TEXTS, awkward, documents, empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(texts, percent=90):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return {(i, len(s), label[i]) for i, s in enumerate(sets)}


def near_copies(rnd, words, copies, edits):
    for _ in range(copies):
        own = list(words)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(len(own))] = f"w{rnd.randrange(10**6)}"
        yield " ".join(own)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices(["th", "er", "On", "an"], k=rnd.randint(1, 3)))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rnd.choice([1, 2, 3, 5, 12, 40, 150, 300]))]
        texts += near_copies(rnd, words, rnd.choice([1, 2, 4]), max(1, len(words) // 25))
    texts += [" ".join([word() for _ in range(rnd.randint(20, 200))] + shared) for _ in range(40)]
    texts += near_copies(rnd, [word() for _ in range(180)], 110, 7)
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "PART", [jj.PART, 6000, 900][seed])  # the large group in several parts
    texts = corpus(seed)
    result = jj.jaccard_components(documents(spark, texts).repartition(5))
    assert {tuple(r) for r in result.collect()} == brute(texts)


def test_frequent_shingles_are_met_in_their_own_way(spark):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    texts = [*near_copies(rnd, words, 150, 4)] + [f"{i} other text {i}" for i in range(30)]
    assert {tuple(r) for r in jj.jaccard_components(documents(spark, texts).coalesce(1)).collect()} == brute(texts)


def test_awkward_texts(spark):
    assert {tuple(r) for r in jj.jaccard_components(documents(spark)).collect()} == brute(TEXTS)
    rows = jj.jaccard_components(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 4
    assert jj.jaccard_components(empty(spark)).count() == 0


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (5, "X y z")], "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in jj.jaccard_components(docs).collect())
    assert found == [(0, 0), (0, 0), (0, 5), (5, 5)]


@pytest.mark.parametrize("seed", range(20))
def test_cluster_join(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.choice(5000, 200, replace=False)
    sets = []
    for _ in range(rnd.integers(2, 60)):
        own = base[rnd.random(len(base)) > rnd.choice([0.02, 0.06, 0.5])]
        sets.append(np.unique(np.concatenate([own, rnd.choice(5000, rnd.integers(0, 12))])).astype(np.uint64))
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert jj.join_cluster(sets, jj.Rule(3, 90)).tolist() == want.tolist()


def test_bit_distance_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rnd.integers(0, 3000, rnd.integers(1, 900))).astype(np.uint64) for _ in range(2))
        assert jj.bit_distance(jj.bit_map(x), jj.bit_map(y)) <= len(np.setxor1d(x, y))


def test_prefix_and_overlap():
    rule = jj.Rule(3, 90)
    for x in range(1, 120):
        for y in range(x, 140):
            o = rule.overlap(x, y)
            assert 100 * o >= 90 * (x + y - o) and not 100 * (o - 1) >= 90 * (x + y - o + 1)
            if o <= x:
                assert x - rule.prefix(x) + 1 <= o and y - rule.prefix(y) + 1 <= o


def test_words_equal_a_plain_split():
    rnd = random.Random(4)
    parts = [" ", "\n", "\t", "a", "B", "é", "日本", "\x1c", " ", "word", "🙂"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(300)]
    words = split_words(pa.array(texts), lower=True)
    hashes = {}
    at = 0
    for i, text in enumerate(texts):
        own = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        assert words.counts[i] == len(own)
        for w in own:
            assert words.doc[at] == i
            assert hashes.setdefault(w, words.hash[at]) == words.hash[at]
            at += 1
    assert len(set(hashes.values())) == len(hashes)


def test_dropping_keeps_one_of_each_component(spark):
    texts = corpus(5)
    docs = documents(spark, texts)
    left = jj.drop_near_copies(docs, size=3, percent=90)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {c for _, _, c in brute(texts)}


def test_dropping_with_five_words(spark):
    texts = corpus(6)
    sets = [shingles(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    left = jj.drop_near_copies(documents(spark, texts), size=5, percent=80)
    assert {r.doc_id for r in left.collect()} == set(label)


def test_dropping_awkward_rows(spark):
    docs = awkward(spark)
    left = jj.drop_near_copies(docs)
    assert left.schema.names == docs.schema.names
    rows = left.collect()
    plain = {" ".join(WORDS.findall(r.text or "")) for r in rows}
    assert {" ".join(WORDS.findall(r.text or "")) for r in docs.collect()} >= plain
    assert sum((r.text or "").startswith("same") for r in rows) == 1
    assert sum(not WORDS.search(r.text or "") for r in rows) >= 4
    assert jj.drop_near_copies(empty(spark)).count() == 0


def test_a_large_cluster_that_pivots_link_in_part(spark, monkeypatch):
    monkeypatch.setattr(jj, "PART", 1500)
    rnd = random.Random(12)
    words = [f"v{i}" for i in range(100)]
    texts = [*near_copies(rnd, words, 120, 6)] + [*near_copies(rnd, words[:50] + words[55:], 60, 2)]
    rnd.shuffle(texts)
    assert {tuple(r) for r in jj.jaccard_components(documents(spark, texts)).collect()} == brute(texts)


def test_different_words_that_balance_are_not_linked(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = jj.jaccard_components(spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_pairs_grow_with_the_sets_of_a_list_and_not_with_their_square(spark, tmp_path, monkeypatch):
    """A list of 3,000 near copies is not read pair by pair; of short lists every pair is."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(3000):
        text = list(base)
        text[rnd.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(text)))
    formed = []
    store = jj.Scratch.store

    def watched(self, df, name):
        kept = store(self, df, name)
        if name == "pairs":
            formed.append(kept.count())
        return kept

    monkeypatch.setattr(jj.Scratch, "store", watched)
    rows = jj.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in rows} == {0}
    assert formed[0] < 3000 * jj.LONG


def test_sets_that_share_a_common_passage_are_not_compared(spark, monkeypatch):
    """A passage of many texts comes last in the order, so it makes no cluster of texts that are otherwise different."""
    monkeypatch.setattr(jj, "LONG", 4)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*(f"w{i}_{k}" for k in range(60)), *passage]) for i in range(40)]
    texts.append(texts[7] + " end")
    read_again = []
    store = jj.Scratch.store

    def watched(self, df, name):
        kept = store(self, df, name)
        if name == "wanted":
            read_again.append(kept.count())
        return kept

    monkeypatch.setattr(jj.Scratch, "store", watched)
    rows = {tuple(r) for r in jj.jaccard_components(documents(spark, texts).repartition(5)).collect()}
    assert rows == brute(texts)
    assert read_again == [2]


def test_counters_of_all_tasks_are_added_up(spark):
    texts = corpus(4)
    docs = documents(spark, texts).repartition(5).selectExpr("doc_id", "text", "xxhash64(text) AS text_key")
    sets = jj.shingle_sets(pa.array(texts), 3)
    counts = np.bincount(jj.counters_of(np.concatenate(sets)), minlength=jj.COUNTERS)
    found = jj._frequency(docs.mapInArrow(jj._profiles(3), jj.PROFILES))
    assert (found == jj._classes(counts)).all()
    assert found.max() > found[counts == 1].max() > found[counts == 0].max() == 0


def test_large_tables_are_deleted_once_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridmill.llm.scratch.run_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(jj, "PART", 900)
    texts = corpus(1)
    result = jj.jaccard_components(documents(spark, texts))
    left = {p.name for p in (tmp_path / "jaccard").iterdir()}
    assert {"profiles", "named"} <= left
    assert not left & {"index", "long", "pairs", "common", "heads", "wanted", "sets", "placed", "nodes"}
    assert {tuple(r) for r in result.collect()} == brute(texts)
