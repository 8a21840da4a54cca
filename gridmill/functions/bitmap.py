"""A bit map of hashed keys: which rows may have a key of a given set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map of which nothing else is said.
MAP_BITS = 1 << 24
#: Bits for each key of a map whose keys are counted: about one other row in sixteen passes.
BITS_A_KEY = 16


def bits_for(n_keys: int) -> int:
    """Bits of a map for so many keys, a power of two."""
    return 1 << max(16, (BITS_A_KEY * n_keys - 1).bit_length())


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    bit = F.pmod(key, F.lit(bits))
    return F.floor(bit / 64), F.pmod(bit, F.lit(64)).cast("int")


def bit_map(hashes: Column, df: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """(word, marks) with a bit set for every value of the 64-bit ``hashes``; ``bits / 64`` rows at most."""
    word, place = _bit(hashes, bits)
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return df.select(word.alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))


def rows_in_map(rows: DataFrame, hashes: Column, marked: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows whose hash is in the map: all that are in its set, and few others.

    The size of the map, which the caller sets, bounds its broadcast. With many more keys than bits it lets most
    rows pass; what comes after has to give the same result then.
    """
    word, place = _bit(hashes, bits)
    tested = rows.withColumns({"_word": word, "_place": place}).join(
        F.broadcast(marked.withColumnRenamed("word", "_word")), "_word"
    )
    return tested.where(F.getbit("marks", F.col("_place")) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def split_by_map(rows: DataFrame, hashes: Column, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash is in the map, and all others; only the first may have a key of the set."""
    word, place = _bit(hashes, MAP_BITS)
    tested = rows.withColumns({"_word": word, "_place": place}).join(
        F.broadcast(marked.withColumnRenamed("word", "_word")), "_word", "left"
    )
    inside = F.coalesce(F.getbit("marks", F.col("_place")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return tested.where(inside).select(*columns), tested.where(~inside).select(*columns)
