import hashlib
import json

from pyspark.sql import functions as F

from logloom.operators.capture import (
    capture_request, capture_response, header_allowlist, prompt_dictionary, reference_prompts, rehydrate_prompts,
)
from logloom.schemas import MESSAGES


def asked(spark, *messages):
    rows = [("r", [(m[0], m[1], m[2] if len(m) > 2 else None) for m in messages])]
    df = spark.createDataFrame(rows, "request_id string, messages array<struct<role: string, content: string, tool_call_id: string>>")
    assert df.schema["messages"].dataType == MESSAGES
    return capture_request(df).first()


def answered(spark, body, error=None, headers=None, **caps):
    df = spark.createDataFrame([(json.dumps(body), error, headers)], "body string, error string, headers map<string, string>")
    return capture_response(df, **caps).first()


def reply(**message):
    return {"choices": [{"message": message}]}


def test_first_and_last_user_message(spark):
    got = asked(spark, ("user", "opener"), ("assistant", "x"), ("tool", "t", "t1"), ("assistant", "y"), ("user", "this one"))
    assert (got["user_question"], got["user_message_this_turn"], got["message_count"]) == ("opener", "this one", 5)
    assert got["tool_results_this_turn"] is None


def test_single_message_and_no_user(spark):
    got = asked(spark, ("user", "hi"))
    assert got["user_question"] == got["user_message_this_turn"] == "hi"
    none = asked(spark, ("system", "s"))
    assert none["user_question"] == "" and none["user_message_this_turn"] == ""


def test_tool_results_after_the_last_assistant(spark):
    got = asked(spark, ("tool", "old", "t0"), ("assistant", "a"), ("tool", "one", "t1"), ("user", "wait"), ("tool", "secret=abc", "t2"))
    assert [(t["tool_call_id"], t["content"]) for t in got["tool_results_this_turn"]] == [("t1", "one"), ("t2", "secret=[REDACTED]")]
    no_assistant = asked(spark, ("tool", "a", "t1"), ("tool", None, "t2"))
    assert [t["content"] for t in no_assistant["tool_results_this_turn"]] == ["a", ""]


def test_caps(spark):
    df = spark.createDataFrame([([("user", "q" * 90, None)],)], "messages array<struct<role: string, content: string, tool_call_id: string>>")
    assert len(capture_request(df, limit=40).first()["user_question"]) == 40
    assert len(capture_request(df, limit=0).first()["user_question"]) == 90


def test_content_is_whole_and_scrubbed_and_preview_short(spark):
    got = answered(spark, reply(content="x" * 5000 + " s3_secret: Ab12Cd"))
    assert len(got["content"]) > 5000 and "Ab12Cd" not in got["content"] and got["content_preview"] == "x" * 200
    assert got["has_content"] and not got["has_tool_calls"] and not got["has_reasoning_content"]


def test_reasoning_fallback(spark):
    assert answered(spark, reply(content="a", reasoning="R"))["reasoning_content"] == "R"
    assert answered(spark, reply(content="a", reasoning_content="P", reasoning="I"))["reasoning_content"] == "P"
    falls = answered(spark, reply(content="a", reasoning_content="", reasoning="I"))
    assert falls["reasoning_content"] == "I" and falls["has_reasoning_content"]


def test_reasoning_cap_is_independent_and_calls_are_whole(spark):
    call = {"function": {"name": "query", "arguments": json.dumps({"sql": "S" * 3000, "s3_key": "leak"})}}
    got = answered(spark, reply(content="F" * 900, reasoning_content="R" * 900, tool_calls=[call]), reasoning_max=100)
    assert len(got["content"]) == 900 and len(got["reasoning_content"]) == 100 and len(got["reasoning_content_preview"]) == 200
    args = json.loads(json.loads(got["tool_calls"])[0]["arguments"])
    assert len(args["sql"]) == 3000 and args["s3_key"] == "[REDACTED]"


def test_no_choice_leaves_flags_out(spark):
    got = answered(spark, {"choices": [], "usage": {"prompt_tokens": 3}})
    assert got["has_content"] is None and got["content"] is None and json.loads(got["tokens"]) == {"prompt_tokens": 3}


def test_error_keeps_only_error_and_headers(spark):
    headers = {"Content-Length": "0", "retry-after": "30", "x-request-id": "abc", "x-inner": "no"}
    got = answered(spark, reply(content="ignored"), error="Provider returned 500: ", headers=headers)
    assert got["content"] is None and got["tokens"] is None and got["has_content"] is None
    assert got["upstream_headers"] == {"content-length": "0", "retry-after": "30", "x-request-id": "abc"}


def test_headers_null_when_none_is_kept(spark):
    df = spark.createDataFrame([({"x-inner": "no"},), (None,)], "h map<string, string>")
    assert [r["x"] for r in df.select(header_allowlist(F.col("h")).alias("x")).collect()] == [None, None]


def test_prompt_dictionary_and_round_trip(spark):
    big = "You are a careful agent. " * 500
    rows = [
        ("r2", "2024-01-01 00:00:02", [("system", big, None), ("user", "q2", None)]),
        ("r1", "2024-01-01 00:00:01", [("system", big, None), ("user", "q1", None), ("system", "short", None)]),
        ("r3", "2024-01-01 00:00:03", [("user", "no prompt", None), ("assistant", None, None)]),
    ]
    df = spark.createDataFrame(rows, "request_id string, ts string, messages array<struct<role: string, content: string, tool_call_id: string>>")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    words = {r["system_sha256"]: r for r in prompt_dictionary(df).collect()}
    key = hashlib.sha256(big.encode()).hexdigest()
    assert len(words) == 2 and words[key]["first_request_id"] == "r1" and words[key]["content"] == big
    refs = reference_prompts(df)
    first = refs.where("request_id = 'r2'").first()["messages"][0]
    assert first["content"] is None and first["system_sha256"] == key and first["content_len"] == len(big)
    back = {r["request_id"]: r["messages"] for r in rehydrate_prompts(refs, prompt_dictionary(df)).collect()}
    assert {k: [tuple(m) for m in v] for k, v in back.items()} == {r[0]: r[2] for r in rows}
