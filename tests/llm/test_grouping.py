"""Helpers that hot keys and repeated rows lean on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmill.llm import words
from gridmill.llm.grouping import join_group_facts, keep_rows
from gridmill.llm.jaccard_join import drop_near_copies

from .cases import DOCS


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_an_unrelated_repeat_changes_nothing_else(spark):
    """Rows without words all stay, whatever other rows there are."""
    empty_rows = [(None, "", "en", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (4, "", "en", "s", 0)]
    repeated = [(7, "one two three four five six", "en", "s", 1)] * 3
    alone = kept(drop_near_copies(spark.createDataFrame(empty_rows, DOCS)))
    both = kept(drop_near_copies(spark.createDataFrame(empty_rows + repeated, DOCS)))
    assert alone == sorted([(None, ""), (None, ""), (None, None), (4, "")], key=repr)
    assert both == sorted([*alone, (7, "one two three four five six")], key=repr)


def test_verdicts_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, None), (3, ""), (None, "x"), (5, "y")], "doc_id bigint, text string")
    raw = F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw")
    # One of the two rows (1, a), both (2, b), none of (3, empty), not (null, x).
    counted = docs.select("doc_id", raw, F.row_number().over(window()).alias("k"))
    verdict = (
        F.when(F.col("doc_id") == 1, F.col("k") == 1).when(F.col("doc_id") == 3, F.lit(False))
        .when(F.col("doc_id").isNull(), F.lit(False)).otherwise(F.lit(True))
    )
    left = keep_rows(docs, counted.select("doc_id", "raw", verdict.alias("kept")))
    assert kept(left) == [(1, "a"), (2, "b"), (2, "b"), (5, "y")]


def window():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "text").orderBy("doc_id")


def test_rows_of_hot_groups_are_not_shuffled(spark, tmp_path):
    """A third of all rows on one key: no task of the shuffled join holds more than three times the median."""
    n = 30_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"))
    rows.write.parquet(str(tmp_path / "rows"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    groups.write.parquet(str(tmp_path / "groups"))
    rows, groups = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "groups"))
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        joined = join_group_facts(rows, n, groups, ["k"], "size")
        placed = joined.where("k <> -1").groupBy(F.spark_partition_id().alias("task")).count().collect()
        found = joined.select("id", "k", "facts.least").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and "BroadcastHashJoin" in text
    sizes = sorted(r["count"] for r in placed)
    assert len(sizes) >= 16 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    least = {}
    for r in found:
        least[r.k] = min(r.id, least.get(r.k, r.id))
    assert len(found) == n and all(r.least == least[r.k] for r in found)


def thue_morse(n, swap=False):
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


def test_words_that_balance_in_a_sum_have_different_hashes():
    texts = [thue_morse(n, swap) for n in (2, 16, 64, 65, 1024, 4096) for swap in (False, True)]
    found = words.split_words(pa.array(texts)).hash
    assert len(set(found.tolist())) == len(texts)


@pytest.mark.parametrize("lower", [False, True])
def test_equal_words_and_only_they_have_equal_hashes(lower):
    rnd = random.Random(6)
    pool = ["".join(rnd.choices("abAB\0é", k=rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 64, 65, 200]))) for _ in range(600)]
    text = " ".join(pool)
    found = words.split_words(pa.array([text, "", "x " + text]), lower=lower)
    plain = [w.translate({i: i + 32 for i in range(65, 91)}) if lower else w for w in text.split(" ")]
    by_word = {}
    for word, value in zip([*plain, "x", *plain], found.hash.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)
    assert np.array_equal(found.counts, [600, 0, 601])
