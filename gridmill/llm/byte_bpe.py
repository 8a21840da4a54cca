"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the encoding of its text exactly if every two neighbours are the encoding of
theirs. So instead of merging pairs, the encoder walks over the text: an Aho-Corasick automaton finds all
vocabulary strings at every place, the longest that is compatible with the token before it is taken, and
where none is, the walk steps back and tries the next shorter one. Every prefix of a text has one valid
encoding, so a place that was left once is never entered again, and the walk is linear in the text.
Whether two tokens may stand side by side is worked out once and remembered: their last merges are undone,
the later one first, along the right edge of the left token and the left edge of the right one, and no pair
that meets at the border may have been due for merging before.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.pretokens import PieceCache, cut, text_slices


def merge_bytes(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by plain merging, which the codec is held against: the neighbours of lowest rank are joined until none can be."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BytePairCodec:
    """Encoder and decoder for a vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 1_000_000):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.remember = remember
        self.known: dict[int, bool] = {}
        self.pieces = PieceCache(self._piece, remember)
        # For decoding: all strings in one array, and where each token's begins.
        size = max(ranks.values(), default=0) + 1
        ordered = sorted(ranks.items(), key=lambda item: item[1])
        self.lengths = np.zeros(size, np.int64)
        self.lengths[[i for _, i in ordered]] = [len(s) for s, _ in ordered]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(s for s, _ in ordered), np.uint8)
        # The last merge of each token. A single byte has none, and a longer string without one is never made
        # by merging, so it can't be part of a longer text's encoding.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        # Bytes become the first 256 characters, as the automaton works on text.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for string, i in ordered:
            if len(string) == 1 or self._last_merge(string, i):
                self.automaton.add_word(string.decode("latin-1"), (i, len(string)))
        self.automaton.make_automaton()

    def _last_merge(self, string: bytes, token: int) -> bool:
        """Find the two tokens of lower rank that are the encoding of a string until it becomes one token."""
        ranks = self.ranks
        for cut_at in range(1, len(string)):
            left = ranks.get(string[:cut_at], token)
            right = ranks.get(string[cut_at:], token)
            if left < token and right < token and self.fit(left, right):
                self.left[token], self.right[token] = left, right
                self.merged[left << 32 | right] = token
                return True
        return False

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes."""
        edge_of_left, edge_of_right, merged = self.right, self.left, self.merged.get
        # Merges across the border with a rank below ``due`` would have come before those that are not undone yet.
        due = 1 << 32
        while True:
            across = merged(left << 32 | right, due)
            if across < due:
                return False
            # Undo the later of the two last merges; of equal ones the left one was made first.
            inner_left, inner_right = edge_of_left[left], edge_of_right[right]
            if inner_left != left and (left > right or inner_right == right):
                due, left = left, inner_left
            elif inner_right != right:
                due, right = right + 1, inner_right
            else:
                return True

    def encode_match(self, text: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is in the vocabulary is one token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n, known = len(text), self.known
        at: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text.decode("latin-1")):
            at[end + 1 - found[1]].append(found)  # shorter ones first, as they end first
        left = bytearray(n + 1)
        ids: list[int] = []
        tried: list[int] = []
        ends: list[int] = []
        pos, last, k = 0, -1, len(at[0]) - 1
        while pos < n:
            tokens = at[pos]
            while k >= 0:
                token, length = tokens[k]
                end = pos + length
                if not left[end]:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.fit(last, token)
                    if fits:
                        break
                k -= 1
            if k >= 0:
                ids.append(token)
                tried.append(k)
                ends.append(pos)
                pos, last, k = end, token, len(at[end]) - 1
            else:
                left[pos] = 1
                ids.pop()
                pos, k = ends.pop(), tried.pop() - 1
                last = ids[-1] if ids else -1
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = [i for match in self.find(piece) for i in self.encode_match(match.encode())]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        first, *rest = cut(text)
        ids = np.frombuffer(self._piece(first) + b"".join(map(self.pieces.__getitem__, rest)), "<u4")
        self.pieces.trim()
        if len(self.known) > self.remember:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.bytes_of(ids).tobytes()

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one token after the other, by one gather."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.bytes[np.arange(int(lengths.sum())) + np.repeat(self.starts[ids] - before, lengths)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec per worker process and file of base64 strings with ranks."""
    with open(path, "rb") as file:
        lines = [line.split() for line in file if line.strip()]
    return BytePairCodec({base64.b64decode(string): int(rank) for string, rank in lines}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, the bytes that the ids stand for) of every document.

    ``path`` is a vocabulary file with one base64 string and its rank a line, found at the same place on
    every executor; ``pattern`` cuts a text into the matches that are encoded separately. Special tokens
    have no meaning inside texts. A null or empty text has no ids. Texts of any length are encoded whole;
    equal rows give equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                ids = [coder.encode(text) for text in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
                ends = np.cumsum(np.concatenate([[0], coder.lengths[flat]]))[offsets].astype(np.int32)
                decoded = [None, pa.py_buffer(ends), pa.py_buffer(coder.bytes_of(flat))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.Array.from_buffers(pa.binary(), len(ids), decoded),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
