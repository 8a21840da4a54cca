"""Words of many texts at once, as hashes in numpy arrays.

The bytes of an Arrow column are handled as one array, so no Python code runs per word or per text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from gridmill.llm.worker import remembered_by

BLOCK = 1 << 20
#: An odd number, of which neighbouring powers differ by little that is divisible by two.
BASE = 0x9E3779B97F4A7C15 | 3


class Words(NamedTuple):
    """Words in order: ``doc`` is the row, ``start`` and ``stop`` byte places in the row's text."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words per row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def small_letters() -> np.ndarray:
    """Each byte, A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@remembered_by("words")
@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2**64."""
    ups = np.full(n, BASE, np.uint64)
    downs = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK, 1 << int(n).bit_length()))


def white_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


WHITE = white_space()


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each text starts (one more for the end)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.StringArray, lower: bool = False) -> Words:
    """All maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    data, at = text_bytes(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64), np.zeros(len(texts), np.int64))
    inside = ~WHITE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = at[1:] > at[:-1]
    opens[at[:-1][filled]] = inside[at[:-1][filled]]
    closes[at[1:][filled] - 1] = inside[at[1:][filled] - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(at, start, "right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    return Words(doc, start - at[doc], stop - at[doc], hash_ranges(data, start, stop, lower), counts)


#: Words of more bytes are hashed one by one.
LONG = 64
#: The bytes of a number that belong to a word with so many bytes left.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_ranges(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each word or line; with ``lower`` A-Z count as a-z.

    Eight bytes at a time go through ``mix``, of all words together, so that words of up to eight bytes have
    different hashes if they have as many bytes. A longer word than ``LONG`` takes its hash from BLAKE2b. No
    sum of bytes is involved, so there are no texts whose bytes balance each other. Ranges come in order; they are
    taken in blocks of about a megabyte, which bounds what is held beside the text.
    """
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(stop, lo + BLOCK, "right")))
        out[i:j] = _hash_block(data[lo : stop[j - 1]], start[i:j] - lo, stop[i:j] - lo, lower)
        i = j
    return out


def _hash_block(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    if lower:
        data = small_letters()[data]
    size = stop - start
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    open_words = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(open_words):
        left = size[open_words] - at
        value = eight[start[open_words] + at] & MASKS[np.minimum(left, 8)]
        out[open_words] = mix(out[open_words] ^ value)
        at += 8
        open_words = open_words[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values; shorter input gives none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up = powers(n)[0]
    sums = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        sums += hashes[k : len(hashes) - n + 1 + k] * up[k]
    return mix(sums)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the same words that go into a window's second hash."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def rolling_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ``window_hashes``, in time that does not depend on ``n``."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])
