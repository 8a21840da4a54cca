"""Joins, ranks and filters that stay even when one key holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.bitmap import bit_map, rows_in_map, split_by_map
from gridmill.llm.scratch import Scratch

#: A group is hot above this share of the rows, so there are fewer hot groups than its inverse.
HOT_SHARE = 0.001


def join_group_facts(rows: DataFrame, n_rows: int, groups: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """``rows`` left-joined to one fact row per group, as the struct column ``facts`` (null: no such group).

    ``size`` names the column of ``groups`` that counts the group's rows. Hot groups are fewer than
    ``1 / HOT_SHARE`` whatever the input, which bounds their broadcast; every other group is too small
    to make a shuffled partition uneven. ``groups`` should be a stored table, as it is read twice.
    """
    facts = F.struct(*[c for c in groups.columns if c not in key])
    hot = F.col(size) > F.lit(HOT_SHARE) * n_rows
    few = groups.where(hot).select(*key, facts.alias("hot_facts"))
    rest = groups.where(~hot).select(*key, facts.alias("rest_facts"))
    tested = rows.join(F.broadcast(few), list(key), "left")
    # Rows of hot groups are done here and stay out of the shuffle; only the others meet the other groups.
    found = tested.where("hot_facts IS NOT NULL").withColumnRenamed("hot_facts", "facts")
    others = tested.where("hot_facts IS NULL").drop("hot_facts").join(rest, list(key), "left")
    return found.unionByName(others.withColumnRenamed("rest_facts", "facts"))


def rank_in_class(items: DataFrame, kind: str, part: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rank``: the place, from 0 and without gaps, of each row among all rows of its ``kind``.

    ``part`` is a stored column that deals the rows into parts of bounded size. A row's rank is the
    number of rows of its kind in earlier parts plus its rank inside its own part, so a kind that holds
    a third of all rows is still ranked by as many tasks as there are parts.
    """
    counts = items.groupBy(kind, part).agg(F.count(F.lit(1)).alias("n_here"))
    before = Window.partitionBy(kind).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(kind, part, F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy(kind, part).orderBy(*order)
    ranked = items.withColumn("rank_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(base, [kind, part])
        .withColumn("rank", F.col("n_before") + F.col("rank_inside"))
        .drop("n_before", "rank_inside")
    )


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``verdicts`` (doc_id, raw, kept) keeps.

    ``raw`` is the xxhash64 of the text (null: empty). There is one verdict for each row of ``docs``. Of rows that
    agree in doc_id and text and have both verdicts, one stays; all other rows have their own verdict, whatever
    there is besides.
    """
    scratch = Scratch(docs.sparkSession, "kept-rows")
    found = scratch.store(verdicts.select("doc_id", "raw", "kept"), "found")
    keys = found.groupBy("doc_id", "raw").agg(F.bool_or("kept").alias("some_kept"), F.bool_and("kept").alias("all_kept"))
    keys = keys.where("not all_kept").select(F.col("doc_id").alias("key_id"), F.col("raw").alias("key_raw"), "some_kept")
    keys = scratch.store(keys, "keys")
    rows = docs.select(
        F.struct("*").alias("document"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("raw"),
    )
    # Only rows that may be gone take part in the join; the texts of all others are not shuffled.
    marked = bit_map(F.xxhash64("key_id", "key_raw"), keys)
    maybe, others = split_by_map(rows, F.xxhash64("doc_id", "raw"), marked)
    same = maybe.doc_id.eqNullSafe(keys.key_id) & (maybe.raw == keys.key_raw)
    if not keys.where("some_kept").isEmpty():
        once = maybe.join(keys.where("some_kept"), same, "semi").groupBy("doc_id", "raw")
        others = others.unionByName(once.agg(F.any_value("document").alias("document")).select("document", "doc_id", "raw"))
    return maybe.join(keys, same, "anti").unionByName(others).select("document.*")


def likely_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (doc_id, text_key) may be in ``wanted``: all that are, and few others.

    For joins that want few of many long texts: the others need not be shuffled. The map behind it has a
    fixed size; with very many keys it lets more rows pass, and the join after it decides as before.
    """
    key = F.xxhash64("doc_id", "text_key")
    return rows_in_map(rows, key, bit_map(key, wanted))

