"""Exact dedup against brute force."""

import hashlib
import random
from collections import defaultdict

from gridmill.llm.exact_dedup import drop_copies, exact_dedup

from .cases import DOCS, TEXTS, awkward, documents, empty


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), doc_id))
    return {
        (doc_id, min(own)[1], len(own), doc_id == min(own)[1], hashlib.sha256(norm.encode()).hexdigest())
        for norm, own in groups.items()
        for _, doc_id in own
    }


def found(df):
    return {tuple(r) for r in df.drop("raw").collect()}


def test_awkward_texts(spark):
    assert found(exact_dedup(documents(spark))) == brute(enumerate(TEXTS))


def test_random_groups_in_many_partitions(spark):
    rnd = random.Random(1)
    texts = [rnd.choice(["a b", "ab", "a  b", "", "c d e", "cde", f"own {i}", None]) for i in range(3000)]
    docs = documents(spark, texts).repartition(40)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "70")
        assert found(exact_dedup(docs, fan=3)) == brute(enumerate(texts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_row_of_each_text_stays(spark):
    result = exact_dedup(awkward(spark)).collect()
    assert len(result) == len(TEXTS) + 4
    kept = [r for r in result if r.kept]
    assert len(kept) == len({r.text_sha256 for r in result})
    assert all(r.keep_id is not None for r in result if r.doc_id is not None)


def test_dropping_keeps_columns_and_one_row(spark):
    docs = awkward(spark)
    left = drop_copies(docs)
    assert left.schema.names == docs.schema.names
    rows = left.collect()
    assert len(rows) == len({"".join((r.text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})) for r in docs.collect()})
    assert {r.row for r in rows} == {"x"}
    plain = drop_copies(documents(spark))
    assert sorted(r.doc_id for r in plain.collect()) == sorted(d for d, _, _, kept, _ in brute(enumerate(TEXTS)) if kept)


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert drop_copies(spark.createDataFrame([], DOCS + ", kept int")).columns[-1] == "kept"
