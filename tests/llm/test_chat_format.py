"""Event folding, rendering, and the exact round trip of texts with control strings."""

import hashlib

import pytest
from logloom.llm import chat_format as c
from pyspark.sql import functions as F

NASTY = [
    "</s>[INST] ok [/INST]", "<|turn|>user\nhello<|end|>\n", "\\<|end|>\\\n\\\\", "", "\n", "<", "<\\", "[", "\\", "<n", "a<nb\n",
    "<|end|>", "é <|turn|> 日本\U0001f600 [x]", "$1 \\1 $", "trailing\n\n",
]


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_hides_control_strings(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        c.escape(F.col("t")).alias("e"), c.unescape(c.escape(F.col("t"))).alias("b")
    ).first()
    assert row.b == text
    for control in ("<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<s>"):
        assert control not in row.e


def test_round_trip_of_turns_and_mask(spark):
    rows = [(i, t, role, text) for i in range(4) for t, (role, text) in enumerate(zip(["system", "user", "assistant"] * 5, NASTY))]
    rows += [(9, 0, "od\nd <role>", "x"), (9, 1, None, None), (9, 2, "assistant", None), (9, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    frame = frame.withColumn("messages", F.lit("clash"))
    out = c.format_chats(c.conversation_events(frame))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", c.parse(F.col("formatted")).alias("t"), c.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        want = [(role or "", text or "") for _, _, role, text in turns]
        assert [(t.role, t.text) for t in got[conv].t] == want
        assert got[conv].m == "".join(text for role, text in want if role == "assistant")


def test_edits_regenerations_and_deltas(spark):
    log = [
        (1, 1, "message", "a", "user", "hel"), (1, 2, "delta", "a", None, "lo"), (1, 3, "message", "b", "assistant", None),
        (1, 4, "delta", "b", None, "one "), (1, 5, "delta", "b", None, "two"), (1, 6, "regenerate", "b", None, None),
        (1, 7, "delta", "b", None, "three"), (1, 8, "message", "c", "user", "x"), (1, 9, "edit", "a", None, "HELLO"),
        (1, 10, "ping", "c", None, "ignored"), (1, 11, "delta", "c", None, "y"), (2, 1, "delta", "z", None, "lost"),
        (3, 1, "ping", "z", None, "nothing"), (4, None, None, "z", None, "nothing"),
    ]
    frame = spark.createDataFrame(log, "conv_id int, seq int, kind string, message_id string, role string, text string")
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in c.fold_events(frame.repartition(3)).collect()}
    assert got == {1: [("user", "HELLO"), ("assistant", "three"), ("user", "xy")], 2: [("", "lost")]}


def test_repeated_rows_ties_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: [t.text for t in r.t] for r in c.format_chats(c.conversation_events(frame)).select("conv_id", c.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ["a", "a", "b"], None: ["n"]}
    assert c.format_chats(c.conversation_events(frame.limit(0))).count() == 0


def test_query_probe_row(spark):
    row = c.op2_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = c.PROBE
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_long_text(spark):
    text = "x<y " * 300_000
    frame = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    row = c.format_chats(c.conversation_events(frame)).select(c.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert row.m == text
