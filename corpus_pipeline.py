"""The corpus pipeline: documents to packed training sequences, one stored stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.exact_dedup import drop_copies
from gridmill.llm.jaccard_join import drop_near_copies
from gridmill.llm.packing import pack_documents
from gridmill.llm.quality_fm import fit, good_documents
from gridmill.llm.queries import END_ID, PATTERN, SEQUENCE, TOKENIZER
from gridmill.llm.scratch import Scratch
from gridmill.llm.suffix_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels, does not reject."""
    return good_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return drop_near_copies(docs, size=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has, too."""
    return remove_repeats(docs, min_words=50, gram=20)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, TOKENIZER, PATTERN, END_ID, SEQUENCE)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the trained classifier nor the packing; the tests hold every stage and their
#: sequence against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written as Parquet and read again by the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
