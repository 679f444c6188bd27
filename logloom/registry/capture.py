"""Queries over raw exchanges: what is captured of requests and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.functions.scrub import BEARER_PATTERN, KEY_VALUE_PATTERN, SQL_SECRET_PATTERN
from logloom.functions.text import cap, compact_view
from logloom.operators import capture
from logloom.registry.base import ntz, query, with_ctes

QUESTION_LIMIT = 120


def scrub_sql(text: str) -> str:
    """The three text rules in the checking engine."""
    for pattern, to in ((KEY_VALUE_PATTERN, r"\1[REDACTED]"), (SQL_SECRET_PATTERN, r"\1 '[REDACTED]'"), (BEARER_PATTERN, r"\1[REDACTED]")):
        quoted, repl = pattern.replace("'", "''"), to.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{repl}', 'g')"
    return text


SAID = f"said AS ({fx.EXCHANGE_ROLES})"
EXCHANGES = """ex AS (
  SELECT concat('x', a.conv_id, '-', a.turn) AS request_id, make_timestamp((1704067200 + a.conv_id * 3600 + a.turn) * 1000000) AS ts,
    a.conv_id, a.turn, a.conv_id + a.turn AS n, a.text AS answer,
    coalesce(list({'turn': p.turn, 'role': p.role, 'text': p.text} ORDER BY p.turn) FILTER (WHERE p.turn IS NOT NULL), []) AS sent,
    max(p.turn) FILTER (WHERE p.role = 'assistant') AS last_answer, arg_max(p.text, p.turn) AS x1
  FROM said a LEFT JOIN said p ON p.conv_id = a.conv_id AND p.turn < a.turn
  WHERE a.said_by = 'assistant' GROUP BY a.conv_id, a.turn, a.text)"""
_USERS = "list_filter(sent, lambda m: m.role = 'user')"


@query(
    "capture_request",
    with_ctes(
        SAID, EXCHANGES,
        body=f"""SELECT request_id, cast(len(sent) AS integer) AS message_count,
          {scrub_sql(f"left(coalesce({_USERS}[1].text, ''), {QUESTION_LIMIT})")} AS user_question,
          {scrub_sql(f"left(coalesce({_USERS}[-1].text, ''), {QUESTION_LIMIT})")} AS user_message_this_turn FROM ex""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capture.capture_request(fx.exchanges(spark, sf_dir), limit=QUESTION_LIMIT)
    return got.select("request_id", "message_count", "user_question", "user_message_this_turn")


_TOOLS = "tools AS (SELECT request_id, list_filter(sent, lambda m: m.role = 'tool' AND m.turn > coalesce(last_answer, -1)) AS t FROM ex)"


@query(
    "tool_results",
    with_ctes(
        SAID, EXCHANGES, _TOOLS,
        body=f"""SELECT request_id, cast(nullif(len(t), 0) AS integer) AS results,
          CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda m: concat('call', m.turn)), '|') END AS ids,
          CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda m: {scrub_sql('m.text')}), '|') END AS contents FROM tools""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fx.exchanges(spark, sf_dir).select("request_id", capture.tool_results_this_turn(F.col("messages")).alias("t"))
    return got.select(
        "request_id",
        F.when(F.col("t").isNotNull(), F.size("t")).alias("results"),
        F.array_join(F.transform("t", lambda m: m["tool_call_id"]), "|").alias("ids"),
        F.array_join(F.transform("t", lambda m: m["content"]), "|").alias("contents"),
    )


_REASONING = "coalesce(CASE WHEN n % 4 = 0 THEN x1 END, CASE WHEN n % 4 = 1 THEN x1 END)"
_ANSWERED = "n % 13 <> 0 AND n % 11 <> 0"
_CONTENT = scrub_sql("coalesce(CASE WHEN n % 7 <> 0 THEN answer END, '')")
_THOUGHT = scrub_sql(f"coalesce({_REASONING}, '')")


@query(
    "capture_response",
    with_ctes(
        SAID, EXCHANGES,
        body=f"""SELECT request_id,
          CASE WHEN {_ANSWERED} THEN n % 7 <> 0 AND answer <> '' END AS has_content,
          CASE WHEN {_ANSWERED} THEN n % 2 = 0 END AS has_tool_calls,
          CASE WHEN {_ANSWERED} THEN nullif({_REASONING}, '') IS NOT NULL END AS has_reasoning_content,
          CASE WHEN {_ANSWERED} THEN {_CONTENT} END AS content,
          CASE WHEN {_ANSWERED} THEN left({_THOUGHT}, 150) END AS reasoning_content,
          CASE WHEN {_ANSWERED} THEN left({_CONTENT}, 200) END AS content_preview,
          CASE WHEN {_ANSWERED} THEN left({_THOUGHT}, 200) END AS reasoning_content_preview,
          CASE WHEN {_ANSWERED} AND n % 2 = 0 THEN concat('[{{"name":"query","arguments":"{{\\"n\\": ', n, ', \\"s3_secret\\": \\"[REDACTED]\\"}}"}}]') END AS tool_calls,
          CASE WHEN n % 13 <> 0 THEN concat('{{"completion_tokens":', length(answer), '}}') END AS tokens,
          CASE WHEN n % 13 = 0 AND conv_id % 2 = 0 THEN cast(turn AS varchar) END AS retry_after,
          CASE WHEN n % 13 = 0 AND conv_id % 2 = 0 THEN 2 END AS headers_kept
          FROM ex""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capture.capture_response(fx.exchanges(spark, sf_dir), reasoning_max=150)
    return got.select(
        "request_id", "has_content", "has_tool_calls", "has_reasoning_content", "content", "reasoning_content",
        "content_preview", "reasoning_content_preview", "tool_calls", "tokens",
        F.try_element_at("upstream_headers", F.lit("retry-after")).alias("retry_after"),
        F.when(F.col("upstream_headers").isNotNull(), F.size("upstream_headers")).alias("headers_kept"),
    )


@query(
    "header_allowlist",
    with_ctes(
        SAID, EXCHANGES,
        body="""SELECT request_id, CASE WHEN conv_id % 2 = 0 THEN concat('retry-after=', turn, ',server=edge') END AS kept FROM ex WHERE n % 13 = 0""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_sort(F.map_entries(capture.header_allowlist(F.col("headers"))))
    text = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return fx.exchanges(spark, sf_dir).where(F.col("error").isNotNull()).select("request_id", text.alias("kept"))


@query("cap_fields", "SELECT doc_id, left(text, 500) AS capped, text AS uncapped FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", cap(F.col("text"), 500).alias("capped"), cap(F.col("text"), 0).alias("uncapped"))


_SHORT = "CASE WHEN length(text) > 200 THEN concat(left(text, 200), '…(+', length(text) - 200, ' chars)') ELSE text END"


@query("compact_view", f"SELECT doc_id, {_SHORT} AS text, {_SHORT} AS inner_text, {_SHORT} AS listed FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.struct("text", "lang").alias("meta"), F.array("text").alias("parts"), F.col("text").alias("messages")
    )
    short = compact_view(docs)
    return short.select("doc_id", "text", F.col("meta.text").alias("inner_text"), F.col("parts")[0].alias("listed"))


SYSTEM = "SELECT ts, request_id, m.text AS body FROM (SELECT ts, request_id, unnest(sent) AS m FROM ex) WHERE m.role = 'system'"


@query(
    "prompt_dictionary",
    with_ctes(
        SAID, EXCHANGES, f"s AS ({SYSTEM})",
        body=f"""SELECT sha256(body) AS system_sha256, ts AS first_ts, request_id AS first_request_id, {scrub_sql("body")} AS content
          FROM s QUALIFY row_number() OVER (PARTITION BY body ORDER BY ts, request_id) = 1""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(capture.prompt_dictionary(fx.exchanges(spark, sf_dir)), "first_ts")


@query(
    "reference_prompts",
    with_ctes(
        SAID, EXCHANGES, f"s AS ({SYSTEM})",
        body="SELECT request_id, sha256(body) AS system_sha256, cast(length(body) AS integer) AS content_len FROM s",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = capture.reference_prompts(fx.exchanges(spark, sf_dir)).select("request_id", F.explode("messages").alias("m"))
    return got.where(F.col("m.system_sha256").isNotNull()).select("request_id", "m.system_sha256", "m.content_len")


@query(
    "rehydrate",
    with_ctes(
        SAID, EXCHANGES,
        body=f"""SELECT request_id, array_to_string(list_transform(sent, lambda m: {scrub_sql('m.text')}), '|') AS prompt FROM ex""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = fx.exchanges(spark, sf_dir)
    back = capture.rehydrate_prompts(capture.reference_prompts(ex), capture.prompt_dictionary(ex))
    return back.select("request_id", F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("prompt"))
