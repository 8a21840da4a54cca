"""Chat texts come back as they were."""

import random

from pyspark.sql import functions as F

from gridmill.llm.chat_format import format_conversations, loss_text, read_back

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<s>", "</s>", "<t>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/", "s>", "</", "é🙂", "\n", " ", "$1", "x", "<\\", "]"]


def round_trip(spark, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA + extra)
    out = format_conversations(df).select(
        "conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return {r.conv_id: r for r in out.collect()}


def check(rows, result):
    groups = {}
    for conv_id, turn, role, text, *_ in rows:
        groups.setdefault(conv_id, []).append((turn is None, turn or 0, role or "", text or ""))
    assert set(groups) == set(result)
    for conv_id, turns in groups.items():
        want = [(role, text) for _, _, role, text in sorted(turns)]
        assert [tuple(t) for t in result[conv_id].turns] == want
        assert result[conv_id].loss == "".join(text for role, text in want if role == "assistant")


def test_random_texts_and_roles(spark):
    rnd = random.Random(1)
    text = lambda: "".join(rnd.choices(PARTS, k=rnd.randint(0, 12)))
    rows = [
        (c, t, rnd.choice(["user", "assistant", "assistant", "system", text(), None]), rnd.choice([text(), text(), None]))
        for c in range(150)
        for t in range(rnd.randint(1, 9))
    ]
    rnd.shuffle(rows)
    check(rows, round_trip(spark, rows))


def test_neighbours_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "tool", "d")]
    row = round_trip(spark, rows)[1]
    assert row.formatted == "<s>[INST]a<t>b</s><s>[/INST]c</s><s>[ROLE]tool[/ROLE]d</s>"
    assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == ["c"]


def test_nulls_ties_and_other_columns(spark):
    rows = [
        (None, None, None, None, "x", 1), (None, 0, "user", "", "x", 1), (2, 5, "user", "b", "x", 1),
        (2, 5, "user", "a", "x", 1), (2, 5, "user", "a", "x", 1), (2, None, "assistant", "late", "x", 1),
    ]
    check(rows, round_trip(spark, rows, ", formatted string, blocks int"))
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"[INST]{t} " * 20) for t in range(600)]
    check(rows, round_trip(spark, rows))
