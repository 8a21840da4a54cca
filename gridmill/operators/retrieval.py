"""Keyword retrieval over heading-aware document chunks, by a scan or by a stored inverted index."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from functools import reduce
from threading import Lock
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import has_word, query_terms, strip_whitespace, unify_newlines, word_set
from gridmill.sources.layers import write_layer

#: Folders that the terms of an index are dealt to.
TERM_BUCKETS = 64
#: Buckets that one task writes.
GROUP_BUCKETS = 4
#: Bits of a chunk number below the number of the part that has the chunk.
PART_BITS = 33
#: How many groups a list aggregate holds in memory before it sorts its input, and how many of (part, term) it may be
#: while an index is built. The list of a group is no longer than its part has chunks.
HASHED_LISTS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
HASHED_GROUPS = 1 << 20
#: Builds that run at the same time share the settings of the session.
_ONE_AT_A_TIME = Lock()
#: Chunks of a block, whose postings stay together in a search for many queries: two to this power.
BLOCK_BITS = 7
#: Pairs of query and chunk that a task of such a search is meant to count, and the most tasks made for that.
TASK_PAIRS = 1 << 20
MOST_TASKS = 20_000

BLANK_LINE = r"\n\s*\n"
DEFAULT_HEADING = "Overview"


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.md`` file under a folder as (source_path, text)."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    )


def _path_pattern(glob: str) -> str:
    """A path pattern as a regular expression: ``*`` stays in its folder, ``**`` goes through all."""
    pieces = [".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)]
    return f"^{''.join(pieces)}$"


def read_documents(spark: SparkSession, root: str, declared: Sequence[str]) -> DataFrame:
    """The text files under a folder that fit one of the ``declared`` patterns, as (source, text).

    ``source`` is (position, path): the place of the first pattern that the path fits, and the path relative to
    ``root``. Its order, and so that of chunks with equal scores, is the declared one, then that of the paths. A
    pattern that no file fits is no error; optional files are the patterns that a caller adds or leaves out.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    # Without scheme and host, and with the characters that a path in a URI can't have.
    place = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    path = F.substr(place, F.lit(len(top) + 2))
    position = F.coalesce(*[F.when(path.rlike(_path_pattern(glob)), F.lit(i)) for i, glob in enumerate(declared)])
    found = files.select(F.struct(position.alias("position"), path.alias("path")).alias("source"), F.col("value").alias("text"))
    return found.where("source.position IS NOT NULL")


def chunk_documents(
    documents: DataFrame, id_column: str = "source_path", text_column: str = "text", separator: str = BLANK_LINE
) -> DataFrame:
    """Paragraphs of each document with the heading they stand under.

    A line that starts with ``#`` opens a section named after it; ``separator`` parts a section into
    paragraphs, and empty ones are dropped. Both splits expand rows in place, without a shuffle.
    """
    sections = documents.select(
        id_column,
        F.posexplode(F.split(unify_newlines(F.col(text_column)), r"\n(?=#)")).alias("section_no", "section"),
    )
    has_heading = F.col("section").startswith("#")
    first_line = F.substring_index("section", "\n", 1)
    title = strip_whitespace(F.regexp_replace(first_line, r"\A#+", ""))
    paragraphs = sections.select(
        id_column,
        "section_no",
        F.when(has_heading & (title != ""), title).otherwise(DEFAULT_HEADING).alias("heading"),
        F.posexplode(
            F.split(
                F.when(has_heading, F.regexp_replace("section", r"\A[^\n]*\n?", "")).otherwise(F.col("section")),
                separator,
            )
        ).alias("paragraph_no", "paragraph"),
    )
    return paragraphs.select(
        id_column, "section_no", "paragraph_no", "heading", strip_whitespace(F.col("paragraph")).alias("text")
    ).where(F.col("text") != "")


def tokenize(documents: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """The word set of each text, sorted."""
    return documents.select(id_column, F.array_sort(word_set(F.col(text_column))).alias("terms"))


def keyword_search(chunks: DataFrame, query: str, limit: int = 5, id_column: str = "source_path") -> DataFrame:
    """Chunks that share most words with the query; ties keep document order, no shared word no hit."""
    terms = query_terms(query)
    if not terms:
        return chunks.withColumn("score", F.lit(0)).limit(0)
    score = reduce(Column.__add__, [has_word(F.col("_searched"), term).cast("int") for term in terms])
    return (
        chunks.withColumn("_searched", F.lower(F.concat_ws(" ", "heading", "text")))
        .withColumn("score", score)
        .drop("_searched")
        .orderBy(F.desc("score"), id_column, "section_no", "paragraph_no")
        .limit(limit)
        # Rows without a match rank last, so filtering the few winners is enough; a filter before
        # the ranking would be pushed down and work out every score twice.
        .where("score > 0")
    )


class DocumentIndex(NamedTuple):
    """Stored tables: chunks with ``chunk_no``, which follows the order of the documents, and (term, chunk_nos)."""

    chunks: DataFrame
    postings: DataFrame


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % TERM_BUCKETS


def _bucket_of(term: str) -> Column:
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def build_document_index(
    chunks: DataFrame, database: str = "documents", id_column: str = "source_path", parts: int | None = None, root: str | None = None
) -> DocumentIndex:
    """Store chunks and their inverted index as the tables ``chunks`` and ``postings`` of a database.

    Chunks are range-dealt in document order, so that their numbers follow it; the upper bits of a number name
    the part, and with it the folder, of the chunk. Postings are dealt by (slice of the parts, group of
    buckets), both known from a row itself, so that no pass over them has to find ranges: a term that is in a third
    of all chunks is written by a task of each slice, and one search opens only the folders of its terms and in
    them the row groups of its terms. A row has the chunks of one part that have the term. ``parts`` is the number of write tasks
    (default: the session's shuffle partitions). Null headings and texts have no terms; repeated chunks count each.
    """
    spark = chunks.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [id_column, "section_no", "paragraph_no"]
    numbered = chunks.repartitionByRange(parts, *order, "text").sortWithinPartitions(*order, "heading", "text")
    numbered = numbered.withColumn("chunk_no", F.monotonically_increasing_id())
    numbered = numbered.withColumn("part", F.shiftright("chunk_no", PART_BITS).cast("int"))
    stored = write_layer(numbered, f"{database}.chunks", partition_by=["part"], root=root, rebalance=False)
    terms = word_set(F.concat_ws(" ", "heading", "text"))
    postings = stored.select(F.explode(terms).alias("term"), "chunk_no", "part")
    groups = TERM_BUCKETS // GROUP_BUCKETS
    slices = -(-parts // groups)
    place = F.col("part") % slices * groups + F.floor(_bucket_of("term") / GROUP_BUCKETS).cast("int")
    dealt = postings.withColumn("place", place).repartitionById(slices * groups, F.col("place"))
    lists = dealt.groupBy("place", "part", "term").agg(F.collect_list("chunk_no").alias("chunk_nos"))
    lists = lists.select("term", "chunk_nos", _bucket_of("term").alias("bucket")).sortWithinPartitions("bucket", "term")
    # A task has far more terms than the 128 groups by default, beyond which every posting would be sorted.
    with _ONE_AT_A_TIME:
        default = spark.conf.get(HASHED_LISTS)
        spark.conf.set(HASHED_LISTS, str(HASHED_GROUPS))
        try:
            kept = write_layer(lists, f"{database}.postings", partition_by=["bucket"], root=root, rebalance=False)
        finally:
            spark.conf.set(HASHED_LISTS, default)
    return DocumentIndex(stored, kept)


def open_document_index(spark: SparkSession, database: str = "documents") -> DocumentIndex:
    """The index that ``build_document_index`` stored."""
    return DocumentIndex(spark.table(f"{database}.chunks"), spark.table(f"{database}.postings"))


def posting_scores(index: DocumentIndex, terms: Sequence[str]) -> DataFrame:
    """chunk_no and score, the number of the terms it has, of every chunk that has any."""
    buckets = sorted({_bucket(term) for term in terms})
    hits = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
    return hits.select(F.explode("chunk_nos").alias("chunk_no")).groupBy("chunk_no").agg(F.count(F.lit(1)).cast("int").alias("score"))


def index_search(index: DocumentIndex, query: str, limit: int = 5) -> DataFrame:
    """The same rows as ``keyword_search``, from a stored index.

    The best ``limit`` chunk numbers are found first, by one job over the postings of the terms; the frame that
    is returned reads these chunks only.
    """
    terms = query_terms(query)
    columns = [c for c in index.chunks.columns if c not in ("chunk_no", "part")]
    best = []
    if terms:
        best = posting_scores(index, terms).orderBy(F.desc("score"), "chunk_no").limit(limit).collect()
    spark = index.chunks.sparkSession
    scores = spark.createDataFrame([(r.chunk_no, r.score) for r in best], "chunk_no bigint, score int")
    wanted = F.col("part").isin([r.chunk_no >> PART_BITS for r in best]) & F.col("chunk_no").isin([r.chunk_no for r in best])
    found = index.chunks.where(wanted).join(F.broadcast(scores), "chunk_no")
    return found.orderBy(F.desc("score"), "chunk_no").select(*columns, "score")


def index_search_all(index: DocumentIndex, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` chunks of many queries: query_id, rank (from 1), score and the columns of the chunks.

    ``queries`` has query_id and query. Postings of the terms are dealt by blocks of chunks first and meet the
    queries there, so that what is sent grows with the postings and not with the pairs of query and chunk; a task has
    about ``TASK_PAIRS`` of these at most. A rank window with a limit keeps the best of each task before they are
    brought together. A query without terms or hits has no rows; repeated query_ids count as one query with all
    their terms.
    """
    terms = queries.select("query_id", F.explode(word_set(F.col("query"))).alias("term")).distinct()
    wanted = terms.select(_bucket_of("term").alias("bucket"), "term").distinct()
    n_queries = terms.agg(F.count_distinct(F.struct("query_id"))).first()[0]
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(parts, n_queries * index.chunks.count() // TASK_PAIRS), max(parts, MOST_TASKS))
    asked = index.postings.join(wanted, ["bucket", "term"], "left_semi")
    block = F.shiftright("chunk_no", BLOCK_BITS)
    dealt = asked.select("term", F.explode("chunk_nos").alias("chunk_no")).withColumn("block", block).repartition(parts, "block")
    scores = dealt.join(terms, "term").groupBy("block", "chunk_no", "query_id").agg(F.count(F.lit(1)).cast("int").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_no")
    best = scores.drop("block").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    best = best.withColumn("part", F.shiftright("chunk_no", PART_BITS).cast("int"))
    columns = [c for c in index.chunks.columns if c not in ("chunk_no", "part")]
    return index.chunks.join(best, ["part", "chunk_no"]).select("query_id", "rank", "score", *columns)
