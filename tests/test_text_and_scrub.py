import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.dialect import repair_arguments, repair_tool_args
from logloom.functions.scrub import REDACTED, may_hold_secret, scrub_document, scrub_json, scrub_text
from logloom.functions.text import app_of, cap, classify_error, compact_view, preview, run_tag_of
from logloom.operators.quality import residual_secrets, scrub_column, scrub_report


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, gone",
    [
        (r"... \"s3_secret\": \"Zq81-abc_DEF\", ...", "Zq81"),
        ("CREATE SECRET s (TYPE S3, KEY_ID 'AK1234', SECRET 'deepvalue')", "AK1234"),
        ("CREATE SECRET s (TYPE S3, KEY_ID 'AK1234', SECRET 'deepvalue')", "deepvalue"),
        ("Authorization: Bearer ab-12.cd_X", "ab-12"),
        ("password = hunter77, next", "hunter77"),
        ("API-KEY:tok99", "tok99"),
    ],
)
def test_scrub_text_removes(spark, text, gone):
    out = one(spark, scrub_text, text)
    assert gone not in out and REDACTED in out
    assert one(spark, scrub_text, out) == out


@pytest.mark.parametrize("text", ["", "nothing to hide", "the monkey key opens", "token of thanks", None])
def test_scrub_text_keeps_clean_text(spark, text):
    assert one(spark, scrub_text, text) == text


def test_gate_never_hides_a_match(spark):
    words = ["s3_secret", "S3KEY", "secret-access-key", "access_key_id", "aws_secret", "AWS-ACCESS", "api_key", "ApiKey", "Secret", "PASSWORD", "token"]
    df = spark.createDataFrame([(f"x {w}: v{i}v y",) for i, w in enumerate(words)], "v string")
    left = df.select(scrub_text(F.col("v")).alias("x")).where(~F.col("x").contains(REDACTED))
    assert left.count() == 0


def test_scrub_json_is_structural(spark):
    args = json.dumps({"sql": "SELECT * FROM t", "s3_key": "AA BB", "s3_secret": "C/D", "s3_endpoint": "store.example.org"})
    doc = json.dumps({"tool_calls": [{"name": "query", "arguments": args}], "n": 5, "api_key": {"inner": "kept", "token": 7}})
    out = json.loads(one(spark, scrub_json, doc))
    inner = json.loads(out["tool_calls"][0]["arguments"])
    assert inner["s3_key"] == inner["s3_secret"] == REDACTED
    assert inner["s3_endpoint"] == "store.example.org" and inner["sql"].startswith("SELECT")
    # A container under a sensitive name is walked, numbers stay.
    assert out["api_key"] == {"inner": "kept", "token": 7} and out["n"] == 5


def test_scrub_json_lists_inherit_the_key_and_names_match_in_full():
    assert json.loads(scrub_document('{"token": ["a", "b"]}')) == {"token": [REDACTED, REDACTED]}
    assert json.loads(scrub_document('{"token_count": "plain"}')) == {"token_count": "plain"}


def test_scrub_json_clean_document_is_byte_identical(spark):
    odd = '{ "a":1,   "content": "{\\"key\\":2}" , "monkey":"x"}'
    assert one(spark, scrub_json, odd) == odd
    assert one(spark, scrub_json, None) is None


def test_scrub_json_falls_back_to_text(spark):
    assert one(spark, scrub_json, "{broken, password: abc123") == f"{{broken, password: {REDACTED}"


def test_escaped_key_names_are_found(spark):
    doc = '{"p\\u0061ssword": "open sesame"}'
    assert json.loads(one(spark, scrub_json, doc)) == {"password": REDACTED}


def test_scrubbed_table_is_a_fixed_point(spark):
    texts = ["KEY_ID '', SECRET ''", "secret=abc", "fine", "Bearer xyz", None]
    df = spark.createDataFrame([("f", t) for t in texts], "file string, v string")
    assert residual_secrets(df, "v", ["file"]).first()["residual_rows"] == 2
    assert residual_secrets(scrub_column(df, "v"), "v", ["file"]).count() == 0


def test_scrub_report_counts(spark):
    df = spark.createDataFrame([("a", '{"secret": "x"}'), ("a", '{"n": 1}'), ("b", '{"n": 2}')], "file string, entry string")
    got = {r["file"]: (r["rows_scanned"], r["rows_changed"], r["needs_rewrite"]) for r in scrub_report(df, "entry", ["file"]).collect()}
    assert got == {"a": (2, 1, True), "b": (1, 0, False)}


def test_caps_and_previews(spark):
    assert one(spark, lambda c: cap(c, 0), "x" * 500) == "x" * 500
    assert one(spark, lambda c: cap(c, 3), "abcdef") == "abc"
    assert one(spark, lambda c: cap(c, 3), None) == ""
    assert one(spark, preview, "y" * 230) == "y" * 200 + "…(+30 chars)"
    assert one(spark, preview, "y" * 200) == "y" * 200


def test_compact_view_reaches_every_depth(spark, rows):
    df = spark.createDataFrame(
        [("a" * 300, [("b" * 300, 1)], {"k": "c" * 300}, ["full"], 7)],
        "s string, l array<struct<t: string, n: int>>, m map<string, string>, messages array<string>, n int",
    )
    got = rows(compact_view(df))[0]
    assert "messages" not in got and got["n"] == 7
    for text in (got["s"], got["l"][0]["t"], got["m"]["k"]):
        assert len(text) == len("x" * 200 + "…(+100 chars)") and text.endswith("…(+100 chars)")


@pytest.mark.parametrize(
    "error, kind",
    [
        ("Request timed out after 5ms", "timeout"), ("Provider returned 429: slow", "http_429"), ("Client disconnected/cancelled after 1ms", "disconnected"),
        ("X API key not configured on server", "not_configured"), ("Unknown model 'a'. Serves: b", "unrouted"),
        ("Streaming is not supported here", "streaming_unsupported"), ("ConnectError: no", "connection"), ("", None), (None, None),
    ],
)
def test_classify_error(spark, error, kind):
    assert one(spark, classify_error, error) == kind


def test_origins(spark):
    assert one(spark, app_of, "https://tpl.example.org/agent_runner_x") == "tpl"
    assert one(spark, run_tag_of, "https://tpl.example.org/agent_runner_x") == "/agent_runner_x"
    assert one(spark, run_tag_of, "https://tpl.example.org") is None
    assert one(spark, app_of, "not a url") == "" and one(spark, app_of, None) is None


INNER = {"by": {"2": {"max": 9.5}}}


@pytest.mark.parametrize(
    "raw, fixed",
    [
        (json.dumps({"id": "x", "v": f"<arg_key>v</arg_key> <arg_value>{json.dumps(INNER)}</arg_value>"}), {"id": "x", "v": INNER}),
        (json.dumps({"v": f"<arg_key>v</arg_key> <arg_value>{json.dumps(INNER)}"}), {"v": INNER}),
        ("<arg_key>id</arg_key> <arg_value>oak</arg_value> <arg_key>op</arg_key> <arg_value>0.5</arg_value>", {"id": "oak", "op": 0.5}),
        (json.dumps({"sql": "<parameter=sql>SELECT 1</parameter>"}), {"sql": "SELECT 1"}),
        ("<parameter=sql>SELECT 1", {"sql": "SELECT 1"}),
    ],
)
def test_repair(spark, raw, fixed):
    got = one(spark, repair_tool_args, raw)
    assert got["repaired"] and json.loads(got["arguments"]) == fixed


@pytest.mark.parametrize("raw", ['{"sql":"a < 5",  "n":3}', "", "[1]", '["<arg_value>x"]', "<arg_key>only a key</arg_key>", None])
def test_repair_leaves_the_rest(spark, raw):
    got = one(spark, repair_tool_args, raw)
    assert got["arguments"] == raw and not got["repaired"]


def test_repair_falsy_payload():
    assert repair_arguments('{"v": "<arg_value>0</arg_value>"}') == ('{"v": 0}', True)


@pytest.mark.parametrize(
    "text",
    [
        "token\u00a0: abc123", "password\u00a0=\u00a0hunter2", "api_key\u2003:\u3000zzz", "secret\x1f=\x1cq1", "Bearer\u00a0abc.def", "KEY_ID\u2009'AK1'",
        "token:x", "no credential", "PASSWORD = 'a b'", "\u00e9token=\u00e9\u00e9",
    ],
)
def test_both_scrubbers_agree(spark, text):
    from logloom.functions.scrub import scrub_plain

    assert one(spark, scrub_text, text) == scrub_plain(text)


def test_deep_and_odd_documents():
    deep = "[" * 50_000 + '{"password": "hush", "n": [1, {"content": "{\\"token\\": \\"hush\\"}"}]}' + "]" * 50_000
    clean = scrub_document(deep)
    assert "hush" not in clean and clean.startswith("[" * 50_000 + "{") and clean.endswith("]" * 50_000)
    assert scrub_document('{"a": "\\u0070assword=hush", "pass\\u0077ord": "hush", "n" : 1e5 }') == (
        f'{{"a": "password={REDACTED}", "pass\\u0077ord": "{REDACTED}", "n" : 1e5 }}'
    )
    assert scrub_document("[" * 30_000 + " token=hush") == "[" * 30_000 + f" token={REDACTED}"
    assert repair_arguments("[" * 50_000) == ("[" * 50_000, False)


def test_repair_reads_tags_from_left_to_right():
    assert json.loads(repair_arguments("<arg_key>a</arg_key>\n<arg_value>1</arg_value><arg_key> b </arg_key><arg_value> two ")[0]) == {"a": 1, "b": "two"}
    assert json.loads(repair_arguments('{"x": "<parameter=x>[1]</parameter>", "y": 2}')[0]) == {"x": [1], "y": 2}
    assert repair_arguments("<arg_key>a</arg_key> no value") == ("<arg_key>a</arg_key> no value", False)


def test_the_gate_lets_through_every_document_that_a_scrub_changes(spark):
    """Random documents of secret-like parts, nested and escaped; a clean log with token counts is not flagged."""
    rng = random.Random(3)
    words = ["token", "tokens", "password", "api_key", "s3-secret", "Bearer", "KEY_ID", "SECRET", "Authorization", "paſſword", "toKen", "passwd"]
    between = [":", "=", ": ", "\n:", "\t=", "' '", " 'x'", " abc", '": "', '\\": \\"', "\x1c=", " :", "", " "]

    def value(depth):
        kind = rng.random()
        if kind < 0.5 or depth > 2:
            return rng.choice(["x ", "", '"', "{"]) + rng.choice(words) + rng.choice(between) + rng.choice(["hush", "'hush'", "5", "", " hush}"])
        if kind < 0.6:
            return rng.randrange(9)
        if kind < 0.75:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        own = {rng.choice([*words, "a", "content", "arguments"]): value(depth + 1) for _ in range(rng.randrange(3))}
        return own if kind < 0.9 else json.dumps(own, ensure_ascii=rng.random() < 0.5)

    docs = []
    for _ in range(6000):
        own = {rng.choice([*words, "a", "content", "arguments"]): value(0) for _ in range(rng.randrange(1, 3))}
        text = json.dumps(own, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        docs.append(text.replace("tok", "\\u0074ok") if rng.random() < 0.05 else text[:-1] if rng.random() < 0.05 else text)
    flagged = spark.createDataFrame([(d,) for d in docs], "t string").select("t", may_hold_secret(F.col("t")).alias("f")).collect()
    assert [r["t"] for r in flagged if not r["f"] and scrub_document(r["t"]) != r["t"]] == []
    clean = ['{"tokens": {"prompt_tokens": 5, "total_tokens": 7}, "note": "the key of a token"}', '{"monkey": 1, "max_tokens": 2}']
    assert spark.createDataFrame([(d,) for d in clean], "t string").where(may_hold_secret(F.col("t"))).count() == 0


def test_the_word_gates_say_what_the_gate_for_all_text_says(spark):
    """ASCII text meets one literal-first pattern per word it holds; whatever is spelled, the verdict is the same."""
    from logloom.functions.scrub import SECRET_GATE, WORD_GATES, _hinted

    rnd = random.Random(5)
    pieces = ['"', '\\"', "'", ":", "=", " ", "\\n", "\\u0041", "\\u017f", "\\", "Tokens", "{", "\t", "\x1c", "_", "-", "s3", "id", "x", "ſ", "é",
              *WORD_GATES, "SECRET", "Key", "access", "api", "auth_", "KEY_ID", "Bearer"]
    docs = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(20_000)]
    c = F.col("t")
    told = spark.createDataFrame([(d,) for d in docs], "t string").select(
        ((_hinted(c) | c.contains("\\u")) & c.rlike(SECRET_GATE)).alias("was"), may_hold_secret(c).alias("now")
    ).groupBy("was", "now").count().collect()
    assert {(r.was, r.now) for r in told} == {(True, True), (False, False)}


def test_a_redacted_document_is_not_looked_at_again(spark):
    """A value that is the marker already costs no Python; one that only looks like it is still redacted."""
    done = ['{"a": "password=[REDACTED]"}', '{"api_key": "[REDACTED]"}', '{"a": "{\\"s3_secret\\": \\"[REDACTED]\\"}"}', '{"a": "KEY_ID \'[REDACTED]\'", "token" : "[REDACTED]"}',
            '{"a": "Bearer [REDACTED]\\ntoken: [REDACTED]\\n"}']
    still = ['{"a": "password=[redacted]"}', '{"a": "password=[REDACTED]x"}', '{"token": "[REDACTED] x"}', '{"token": "[REDACTED]\\" x"}', '{"a": "token: [REDACTED]\\/x"}',
             '{"a": "SECRET  \'[REDACTED]\'"}', '{"token": ["x"]}', '{"a": "token: \\u0001"}', '{"a": "token: \x01"}']
    kept = [r.t for r in spark.createDataFrame([(d,) for d in done + still], "t string").where(may_hold_secret(F.col("t"))).collect()]
    assert kept == still and all(scrub_document(d) == d for d in done) and all(scrub_document(d) != d for d in still)


def test_documents_without_escapes_are_scrubbed_natively_as_in_python(spark):
    from logloom.functions.scrub import _is_plain, _scrub_plain_document

    rnd = random.Random(7)
    pieces = ["token", "Password", "SECRET", "KEY_ID", "s3_key", "secret_access_key", "access-key-id", "aws_secret", "Bearer", "x", "1", ":", "=", " ", "  ", "'", ",", "}", "{", "[",
              "]", "[REDACTED]", ";", "-"]
    text = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8)))
    docs = [json.dumps({text() + "_": text(), "content": rnd.choice([text(), "[1, {}]", None]), "list": [text(), {"n": 1.5, "k": text()}]}) for _ in range(5_000)]
    whole = len(docs)
    docs += [d[:-1] for d in docs[:500]] + [d + d for d in docs[:500]] + [d + "]" for d in docs[:500]]
    docs += ['{"token": "x"}', '{"a": "token=é"}', '{"a": "token=x\\n"}', '{"a": "token=x\t"}']
    c = F.col("t")
    told = spark.createDataFrame(list(enumerate(docs)), "i int, t string").select("i", "t", _is_plain(c).alias("plain"), _scrub_plain_document(c).alias("now"), scrub_json(c).alias("any")).collect()
    assert all(r["any"] == scrub_document(r.t) and (not r.plain or r.now == r["any"]) for r in told)
    assert all(r.plain == (r.i < whole) for r in told) and sum(r.plain and r.now != r.t for r in told) > 500
