"""Cutting texts into small pieces that a byte-level BPE tokenizer encodes one by one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc

#: A space between two characters that are no white space always opens the next match of the pattern.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r"\s | \s")


def cut(text: str) -> list[str]:
    """Pieces whose encodings, put together, are that of ``text``.

    Every piece after the first stands for itself with one space before it; the space is left out.
    """
    return LONE_SPACE.split(text) if OTHER_SPACE.search(text) else text.split(" ")


class PieceCache(dict):
    """Remembers what ``make`` gives for a piece with its space; ``trim`` drops the older half beyond ``limit`` entries."""

    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str):
        value = self[piece] = self.make(" " + piece)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            for piece in list(islice(self, len(self) // 2)):
                del self[piece]


def text_slices(batch: pa.RecordBatch, most: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``most`` bytes of text; one text is never cut."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(ends.searchsorted(before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the files of byte-level tokenizers, inverted.

    Printable Latin-1 bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of the byte strings, and ids of the special strings, of a byte-level BPE file in JSON.

    Raises where the file is of another kind, or where its merges are not in the order of their ids, as
    then the ids could not serve as ranks.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    value = byte_characters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(pair)] for pair in pairs]
    if ids != sorted(set(ids)):
        raise ValueError(f"The merges of {path} are not in the order of their ids")
    return {bytes(value[c] for c in k): i for k, i in model["vocab"].items() if k not in special}, special
