"""Token counts with a whole-token shortcut.

Most matches of the tokenizer's pattern are either a vocabulary string or made of a few. When the counter
is loaded, it proves with the tokenizer itself which vocabulary strings encode alone as one token; a match
that is one of them counts one and is not merged. Only the other matches are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.pretokens import PieceCache, byte_level_ranks, cut, text_slices


class ByteLevelCounter:
    """Counts the tokens of texts for a byte-level BPE file in JSON."""

    def __init__(self, path: str, pattern: str, remember: int = 200_000):
        from tokenizers import Tokenizer

        ranks, self.special = byte_level_ranks(path)
        self.find = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("rest", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        strings = {}
        for string, i in ranks.items():
            try:
                text = string.decode()
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text]:
                strings[text] = i
        proof = Tokenizer.from_file(path).encode_batch(list(strings), add_special_tokens=False)
        self.single = {text for (text, i), found in zip(strings.items(), proof) if found.ids == [i]}
        self.pieces = PieceCache(self._piece, remember)

    def _piece(self, piece: str) -> int:
        if piece in self.single:
            return 1
        single, merge = self.single, self.merge
        return sum(1 if match in single else len(merge(match)) for match in self.find(piece))

    def count(self, text: str) -> int:
        for string in self.special:
            if string in text:
                before, _, after = text.partition(string)
                parts = [before, *after.split(string)]
                return len(parts) - 1 + sum(map(self.count, parts))
        first, *rest = cut(text)
        n = self._piece(first) + sum(map(self.pieces.__getitem__, rest))
        self.pieces.trim()
        return n


@lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    """The counting function of a tokenizer file, one per worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    try:
        return ByteLevelCounter(path, pattern).count
    except ValueError:  # another kind of tokenizer: its library counts
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of every document.

    The counts are those of the library for the file: whole texts, no added tokens; special strings in a
    text count as the library takes them by default. A null text counts as empty: no bytes, no tokens.
    Equal rows give equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            for part in text_slices(batch):
                text = part.column("text")
                n = [count(t) for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pc.binary_length(text).cast(pa.int64()),
                        pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
