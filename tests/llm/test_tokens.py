"""Encoding, decoding, counting and packing against the public libraries."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridmill.llm import byte_bpe, packing, pretokens, token_count

from .cases import TEXTS, awkward, empty

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["th", "er", "ing", " ", "  ", "\n", " \n", "'s", "é", "ñ", "日", "🙂", "!!", "1", "23", "A", "zq", " ", "_", "aaaa"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(n)]


def test_backtracking_equals_merging(library):
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    for text in [t for t in TEXTS if t is not None] + random_texts(1500, 1):
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_backtracking_on_random_bytes():
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(2)
    for _ in range(400):
        text = bytes(rnd.choices([*b"thering", *range(256)], k=rnd.randint(1, 40)))
        want = [codec.ranks[text]] if text in codec.ranks else byte_bpe.merge_bytes(text, codec.ranks)
        assert codec.encode_match(text) == want


def test_small_vocabulary_needs_steps_back():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"cab": 6, b"bcab": 7}
    codec = byte_bpe.BytePairCodec(ranks, r"\S+")
    rnd = random.Random(3)
    for _ in range(500):
        text = bytes(rnd.choices(b"abc", k=rnd.randint(1, 14)))
        want = [ranks[text]] if text in ranks else byte_bpe.merge_bytes(text, ranks)
        assert codec.encode_match(text) == want


def test_cut_pieces_join_to_the_text():
    for text in [t for t in TEXTS if t is not None] + random_texts(300, 4):
        assert " ".join(pretokens.cut(text)) == text


def test_encode_documents(spark, library):
    rows = byte_bpe.encode_documents(awkward(spark), RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 4
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, text in enumerate(TEXTS):
        assert by_id[i].ids == library.encode_ordinary(text or "")
        assert bytes(by_id[i].decoded) == (text or "").encode()
    assert byte_bpe.encode_documents(empty(spark), RANKS, P.PATTERN).count() == 0


def test_counts_equal_the_library(spark, tokenizer):
    count = token_count.counter(JSON, P.PATTERN)
    for text in random_texts(800, 5):
        assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    rows = token_count.count_tokens(awkward(spark), JSON, P.PATTERN, 1024).collect()
    assert len(rows) == len(TEXTS) + 4
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (by_id[i].n_bytes, by_id[i].n_tokens, by_id[i].over_limit) == (len((text or "").encode()), n, n > 1024)
    assert token_count.count_tokens(empty(spark), JSON, P.PATTERN, 1024).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_tokenizers(name):
    path = P.path(name)
    count = token_count.counter(path, P.PATTERN)
    if name.endswith(".model"):
        import sentencepiece

        want = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        want = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    for text in ["", "The other day", "日本語 x"]:
        assert count(text) == want(text)


def fill(runs, capacity):
    """Sequences as lists of (offset, length) that a plan makes."""
    bins = defaultdict(list)
    for run in runs:
        for k in range(run.n):
            for j in range(run.each):
                bins[run.sequence + k].append((run.offset + j * run.length, run.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole_and_tight(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 100, 1024])
    low, high = sorted(rnd.choices(range(1, capacity + 1), k=2))
    counts = Counter(rnd.randint(low, high) for _ in range(rnd.choice([1, 50, 3000])))
    runs = packing.plan_sequences(counts, capacity)
    used = Counter()
    for run in sorted(runs, key=lambda r: r.lo):
        assert run.lo == used[run.length]
        used[run.length] += run.each * run.n
    assert used == counts
    bins = fill(runs, capacity)
    assert sum(sum(length for _, length in b) for b in bins.values()) == sum(k * v for k, v in counts.items())
    plain = []  # first-fit decreasing, one item at a time
    for length in sorted(counts.elements(), reverse=True):
        at = next((i for i, room in enumerate(plain) if room >= length), None)
        if at is None:
            plain.append(capacity - length)
        else:
            plain[at] -= length
    assert len(bins) <= len(plain) * 1.02 + 1


def test_packed_documents(spark, tokenizer):
    docs = awkward(spark)
    rows = packing.pack_documents(docs, JSON, P.PATTERN, 2, 1024, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        if i in (3, 21):
            continue
        own = sorted(pieces[i], key=lambda r: r.piece)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.length == 1024 for r in own[1:])
    assert len(pieces[3]) == 2 and len(pieces[21]) == 3 and len(pieces[None]) == 1
    assert packing.pack_documents(empty(spark), JSON, P.PATTERN, 2, 1024).count() == 0
