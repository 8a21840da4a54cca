"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into a
block by an array aggregation; the blocks are concatenated to one text. ``<s>`` and ``</s>`` enclose a
block, ``[INST]`` opens one of the user, ``[/INST]`` one of the assistant, ``[ROLE]name[/ROLE]`` one of any
other role, and ``<t>`` parts the turns of a block. A control string inside a text gets a backslash after its
bracket, one with backslashes there gets one more, so texts come back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(/?(?:[st]>|(?:INST|ROLE)\]))"
USER, ASSISTANT = "user", "assistant"
MERGED = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def _merge(blocks: Column, turn: Column) -> Column:
    last = F.get(blocks, F.size(blocks) - 1)
    longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
    fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    return F.when(
        last["role"] == turn["role"], F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))
    ).otherwise(F.concat(blocks, F.array(fresh)))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(block: Column) -> Column:
    """The strings of a block in order, each with whether the loss counts there."""
    role, mute = block["role"], F.lit(False)
    opening = (
        F.when(role == USER, "[INST]")
        .when(role == ASSISTANT, "[/INST]")
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]")))
    )
    texts = F.flatten(
        F.transform(
            block["texts"],
            lambda t: F.array(_segment(F.lit("<t>"), mute), _segment(escape(t), role == ASSISTANT)),
        )
    )
    return F.concat(
        F.array(_segment(F.concat(F.lit("<s>"), opening), mute)),
        F.slice(texts, 2, F.size(texts) - 1),
        F.array(_segment(F.lit("</s>"), mute)),
    )


def _spans(state: Column, segment: Column) -> Column:
    stop = state["at"] + F.char_length(segment["text"])
    span = F.array(F.struct(state["at"].alias("start"), stop.alias("stop")))
    spans = F.when(segment["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
    return F.struct(stop.alias("at"), spans.alias("spans"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, stop in code points) of every conversation.

    Turns are ordered by ``turn`` (null last), then role, then text, so repeated rows have a defined place and
    all stay. Null texts and roles count as empty; rows without ``conv_id`` are one conversation. A loss span
    covers the escaped text of one assistant turn. Other columns are ignored; no rows give no rows.
    """
    turn = F.struct(
        F.isnull("turn").alias("late"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.aggregate("turns", F.array().cast(MERGED), _merge).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", _segments)).alias("segments"))
        .select(
            "conv_id",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
            F.aggregate("segments", start, _spans)["spans"].alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""

    def turns(block: Column) -> Column:
        named = F.regexp_extract(block, r"^\[ROLE\]([\s\S]*?)\[/ROLE\]", 1)
        role = F.when(block.startswith("[INST]"), USER).when(block.startswith("[/INST]"), ASSISTANT)
        skip = F.when(block.startswith("[INST]"), 7).when(block.startswith("[/INST]"), 8)
        body = F.substr(block, F.coalesce(skip, F.char_length(named) + 14))
        return F.transform(
            F.split(body, "<t>"),
            lambda t: F.struct(F.coalesce(role, unescape(named)).alias("role"), unescape(t).alias("text")),
        )

    inner = F.substr(formatted, F.lit(4), F.char_length(formatted) - 7)
    return F.flatten(F.transform(F.split(inner, "</s><s>"), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    parts = F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"])))
    return F.array_join(parts, "")
