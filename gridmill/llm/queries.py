"""Registered queries over the whole tables, with production parameters, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.byte_bpe import encode_documents
from gridmill.llm.chat_format import format_conversations, loss_text, read_back
from gridmill.llm.exact_dedup import exact_dedup
from gridmill.llm.jaccard_join import jaccard_components
from gridmill.llm.language_id import fit as fit_languages
from gridmill.llm.language_id import held_out, identify
from gridmill.llm.packing import pack_documents
from gridmill.llm.quality_fm import fit, score
from gridmill.llm.ring_shards import shard_documents
from gridmill.llm.robust_rules import robust_rules
from gridmill.llm.suffix_dedup import repeated_passages
from gridmill.llm.token_count import count_tokens
from gridmill.llm.vector_codes import fit_codes, with_label_errors
from gridmill.llm.whitening import whiten

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
SEQUENCE = 1024
END_ID = 2
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("raw")


OP1_SQL = r"""
WITH facts AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM facts
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted conversations read back; one more conversation says the control strings themselves."""
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = format_conversations(turns).select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS merged,
           length(regexp_replace(text, '([<\[])(\\*)(/?(?:[st]>|(?:INST|ROLE)\]))', '\1\\\2\3', 'g')) AS escaped,
           length(regexp_replace(role, '([<\[])(\\*)(/?(?:[st]>|(?:INST|ROLE)\]))', '\1\\\2\3', 'g')) AS role_escaped
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN merged THEN 3 ELSE 7 + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
                               ELSE 13 + role_escaped END END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, END_ID, SEQUENCE)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50, gram=20).drop("text_key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, SEQUENCE)


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs), with_spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_errors(fit_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6))


def _op13_sql(rounds: int = 6) -> str:
    """Every round spelled out: nearest entries by squared distance and number, then floors of the means."""
    apart = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, 9))
    means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, 9))
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, q.p, min(({apart}) * 16 + j) AS m FROM q JOIN b{i} b ON q.p = b.p GROUP BY r, q.p)"
        )
        if i < rounds:
            steps.append(
                f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN ("
                f"SELECT q.p, m % 16 AS j, [{means}] AS c FROM q JOIN a{i} a ON q.r = a.r AND q.p = a.p GROUP BY 1, 2"
                ") s ON b.p = s.p AND b.j = s.j)"
            )
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), q AS MATERIALIZED (
    SELECT r, p, list_transform(embedding[8 * p + 1 : 8 * p + 8], lambda c: CAST(floor(CAST(c AS DOUBLE) * 4096) AS BIGINT)) AS v
    FROM kept, range(8) t(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS j, v AS c FROM q WHERE r <= 16),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds}),
codes AS (SELECT r, string_agg(printf('%02x', CAST(m % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error
          FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), book
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of the session and the table folder."""
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_quality_fm": op7_quality_fm,
        "op8_ring_shards": op8_ring_shards,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_robust_rules": op10_robust_rules,
        "op11_language_id": op11_language_id,
        "op12_whitening": op12_whitening,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    """The same results as SQL; queries that SQL cannot express are held against brute force in the tests."""
    return {"op1_exact_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op13_vector_codes": _op13_sql()}
