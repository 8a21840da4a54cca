import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridmill.functions import query_terms
from gridmill.operators import retrieval
from gridmill.operators.retrieval import (
    PART_BITS,
    TERM_BUCKETS,
    build_document_index,
    chunk_documents,
    index_search,
    index_search_all,
    keyword_search,
    open_document_index,
    posting_scores,
    read_documents,
    read_markdown,
    tokenize,
)

from helpers import values


def documents(spark, *texts):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "source_path bigint, text string")


def chunks(spark, text, **options):
    rows = chunk_documents(documents(spark, text), **options).orderBy("section_no", "paragraph_no").collect()
    return [(row.heading, row.text) for row in rows]


CASES = {
    "plain text": [("Overview", "plain text")],
    "# Title\n\nFirst.\n\nSecond\nline.\n## Part\nThird.": [
        ("Title", "First."), ("Title", "Second\nline."), ("Part", "Third."),
    ],
    "intro\n# A\n# B\nbody\n\n\n \t\nmore\n#\nunder empty heading": [
        ("Overview", "intro"), ("B", "body"), ("B", "more"), ("Overview", "under empty heading"),
    ],
    "no # heading here\n #not a heading\n\nx": [("Overview", "no # heading here\n #not a heading"), ("Overview", "x")],
    "#only heading": [],
    "": [],
    "\n\n  \n": [],
    "a\r\n\r\nb\rc # Wide  body\x0b\x0bend": [("Overview", "a"), ("Overview", "b\nc # Wide  body"), ("Overview", "end")],
    "##  Spaced  \n　text　\n\n ": [("Spaced", "text")],
    "# A\n\nx\n\n#B\ny": [("A", "x"), ("B", "y")],
}


@pytest.mark.parametrize("text", CASES)
def test_chunks_follow_headings_and_blank_lines(spark, text):
    assert chunks(spark, text) == CASES[text]


def test_separator_is_a_parameter(spark):
    assert chunks(spark, "a\nb\n\nc", separator="\n") == [("Overview", "a"), ("Overview", "b"), ("Overview", "c")]


TOKENS = {
    "The Boiler_2 readings of the plant, and a PLANT x 42!": ["42", "boiler_2", "plant", "readings"],
    "how what été": [],
    "": [],
}


@pytest.mark.parametrize("text", TOKENS)
def test_tokens_are_a_set_without_stop_words(spark, text):
    assert tokenize(documents(spark, text), "source_path").first().terms == TOKENS[text]


def test_search_ranks_by_shared_terms(spark):
    docs = documents(
        spark, "# Plant\n\nBoiler 2 readings come in late.", "# Store\n\nAll readings by hour.", "nothing"
    )
    hits = keyword_search(chunk_documents(docs), "Boiler readings").collect()
    assert [(hit.source_path, hit.score) for hit in hits] == [(0, 2), (1, 1)]
    assert "_searched" not in hits[0]


def test_search_sees_headings_and_whole_words_only(spark):
    docs = documents(spark, "# Grid\nbody", "gridlock", "pre_grid", "(grid)", "grid2")
    hits = keyword_search(chunk_documents(docs), "grid", limit=10).collect()
    assert [hit.source_path for hit in hits] == [0, 3]


def test_search_without_terms_or_matches(spark):
    index = chunk_documents(documents(spark, "# Project\n\nwarehouse"))
    assert keyword_search(index, "turbine qqq").count() == 0
    assert keyword_search(index, "the of a").count() == 0
    assert keyword_search(index, "the of a").columns == keyword_search(index, "x1").columns


def test_ties_keep_document_order_and_limit(spark):
    docs = documents(spark, *["grid\n\ngrid"] * 4)
    hits = keyword_search(chunk_documents(docs), "grid", limit=3).collect()
    assert [(h.source_path, h.paragraph_no) for h in hits] == [(0, 0), (0, 1), (1, 0)]


def test_query_terms():
    assert query_terms("What is THE peak peak of Meter_7 a?") == ["meter_7", "peak"]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "README.md").write_text("# Plant\n\nBoiler 2.", encoding="utf-8")
    (tmp_path / "docs" / "a.md").write_text("# A\n\nText.", encoding="utf-8")
    (tmp_path / "x.txt").write_text("no", encoding="utf-8")
    read = read_markdown(spark, str(tmp_path))
    assert sorted(path.rsplit("/", 1)[1] for path, _ in values(read)) == ["README.md", "a.md"]
    assert values(chunk_documents(read), "heading", "text") == [("A", "Text."), ("Plant", "Boiler 2.")]


@pytest.fixture
def library(spark):
    """Chunks of random words; one word is in most of them, and some documents repeat."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, "common " * rnd.randint(0, 1) + " ".join(rnd.choices(vocabulary, k=5)) + "\n\n# H w1\nlast") for i in range(80)]
    rows += [rows[7], rows[7], (900, ""), (901, None)]
    yield chunk_documents(spark.createDataFrame(rows, "source_path bigint, text string"))
    spark.sql("DROP DATABASE IF EXISTS test_library CASCADE")


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_index_gives_what_the_scan_gives(spark, library):
    built = build_document_index(library, "test_library", parts=6)
    index = open_document_index(spark, "test_library")
    assert built.chunks.columns == index.chunks.columns
    for query, limit in (("common w1 w2", 5), ("w3 W4 w5 the w3", 100), ("w1", 3), ("nothing", 5), ("of the", 5), ("common", 70)):
        want = plain(keyword_search(library, query, limit))
        assert plain(index_search(index, query, limit)) == want, query
        asked = spark.createDataFrame([(7, query), (8, ""), (9, None)], "query_id int, query string")
        found = index_search_all(index, asked, limit).orderBy("query_id", "rank")
        assert [r[3:] + (r[2],) for r in plain(found)] == want
        assert [r[:2] for r in plain(found)] == [(7, i + 1) for i in range(len(want))]


def test_a_search_opens_only_the_files_of_its_terms(spark, library):
    index = build_document_index(library, "test_library", parts=30)
    scores = posting_scores(index, ["common"])
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term,common)" in text or "In(term, [common])" in text
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    # The common word is dealt to several tasks, and its bucket is a small part of all files.
    opened = files(index.postings.where(f"bucket = {zlib.crc32(b'common') % TERM_BUCKETS}"))
    assert len(files(index.postings.where("term = 'common'"))) > 1 and len(opened) < len(files(index.postings)) / 4
    hit = index_search(index, "common", 2)
    text = hit._jdf.queryExecution().executedPlan().toString()
    assert "part" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_many_queries_are_counted_where_the_chunks_are(spark, library, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 8)
    index = build_document_index(library, "test_library", parts=6)
    rnd = random.Random(5)
    asked = [(i, "common " + " ".join(f"w{rnd.randint(0, 60)}" for _ in range(6))) for i in range(12)]
    asked += [(3, "w1 w2"), (None, "w5 w6"), (None, "w7"), (77, "the"), (78, None)]
    found = index_search_all(index, spark.createDataFrame(asked, "query_id int, query string"), 4)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+, chunk_no", text), "pairs of query and chunk are sent"
    terms = defaultdict(set)
    for query_id, query in asked:
        terms[query_id] |= set(query_terms(query or ""))
    words = {(r.source_path, r.section_no, r.paragraph_no, i): set(query_terms(f"{r.heading} {r.text}")) for i, r in enumerate(library.collect())}
    want = []
    for query_id, own in terms.items():
        hits = sorted((-len(own & have), key[:3]) for key, have in words.items() if own & have)[:4]
        want += [(query_id, i + 1, -score, *key) for i, (score, key) in enumerate(hits)]
    columns = ("query_id", "rank", "score", "source_path", "section_no", "paragraph_no")
    assert Counter(plain(found.select(*columns))) == Counter(want)


def test_postings_are_dealt_without_a_pass_for_ranges(spark, library, monkeypatch):
    ranged, frame = [], type(library)
    before = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: ranged.append(a) or before(self, *a))
    index = build_document_index(library, "test_library", parts=40)
    assert len(ranged) == 1  # the chunks
    assert spark.conf.get(retrieval.HASHED_LISTS) == "128"
    files = index.postings.groupBy("bucket", F.input_file_name().alias("file")).agg(F.count("*").alias("n")).groupBy("bucket").count()
    assert {r["count"] for r in files.collect()} <= {1, 2, 3}
    stored = index.postings.collect()
    assert max(len(r.chunk_nos) for r in stored) > 1 and all(len({n >> PART_BITS for n in r.chunk_nos}) == 1 for r in stored)
    rows = Counter((r.term, n) for r in stored for n in r.chunk_nos)
    assert rows == Counter((w, r.chunk_no) for r in index.chunks.collect() for w in query_terms(f"{r.heading} {r.text}"))


def test_index_of_no_chunks(spark, library):
    index = build_document_index(library.where("false"), "test_library", parts=2)
    assert index_search(index, "w1").count() == 0
    assert index_search_all(index, spark.createDataFrame([(1, "w1")], "query_id int, query string")).count() == 0


def test_documents_in_declared_order(spark, tmp_path):
    for name in ("README.md", "docs/b plus+.md", "docs/a.md", "docs/deep/x.md", "reports/2024/r.md", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n\nturbine", encoding="utf-8")
    declared = ["README.md", "missing.md", "docs/*.md"]
    found = read_documents(spark, str(tmp_path), declared).orderBy("source")
    assert [tuple(r.source) for r in found.collect()] == [(0, "README.md"), (2, "docs/a.md"), (2, "docs/b plus+.md")]
    with_reports = read_documents(spark, str(tmp_path), ["reports/**", *declared])
    hits = keyword_search(chunk_documents(with_reports, "source"), "turbine", 2, id_column="source").collect()
    assert [h.source.path for h in hits] == ["reports/2024/r.md", "README.md"]
    assert read_documents(spark, str(tmp_path), ["none/*"]).count() == 0
