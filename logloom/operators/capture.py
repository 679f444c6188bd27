"""What is kept of one model call: fields of the request, fields of the response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import blank_to_null
from logloom.functions.scrub import scrub_json, scrub_text
from logloom.functions.text import PREVIEW_CHARS, TOOL_RESULT_MAX, USER_QUESTION_MAX, cap
from logloom.schemas import RESPONSE_BODY

# The upstream response headers worth keeping on an error.
HEADER_ALLOWLIST = (
    "retry-after", "x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-reset",
    "x-request-id", "server", "date", "content-length",
)


def _said_by(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def first_user_message(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(_said_by(messages, "user"), F.lit(1))["content"], F.lit(""))


def last_user_message(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(_said_by(messages, "user"), F.lit(-1))["content"], F.lit(""))


def tool_results_this_turn(messages: Column, limit: int = TOOL_RESULT_MAX) -> Column:
    """Tool results since the last assistant message, in order; NULL when none.

    Messages of other roles in between are skipped.
    """
    roles = F.transform(messages, lambda m: m["role"])
    since_assistant = F.array_position(F.reverse(roles), F.lit("assistant"))
    tail_length = F.when(since_assistant > 0, since_assistant - 1).otherwise(F.size(messages)).cast("int")
    tail = F.slice(messages, F.greatest(F.size(messages) - tail_length + 1, F.lit(1)), tail_length)
    results = F.transform(
        _said_by(tail, "tool"),
        lambda m: F.struct(
            m["tool_call_id"].alias("tool_call_id"), scrub_text(cap(m["content"], limit)).alias("content")
        ),
    )
    return F.when(F.size(results) > 0, results)


def capture_request(df: DataFrame, messages: str = "messages", limit: int = USER_QUESTION_MAX) -> DataFrame:
    """Adds message_count, user_question, user_message_this_turn, tool_results_this_turn."""
    m = F.col(messages)
    return df.select(
        "*",
        F.size(m).alias("message_count"),
        scrub_text(cap(first_user_message(m), limit)).alias("user_question"),
        scrub_text(cap(last_user_message(m), limit)).alias("user_message_this_turn"),
        tool_results_this_turn(m).alias("tool_results_this_turn"),
    )


def header_allowlist(headers: Column) -> Column:
    """The kept headers with lower-case names and scrubbed values; NULL when none."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    kept = F.map_filter(lowered, lambda k, _: k.isin(*HEADER_ALLOWLIST))
    clean = F.transform_values(kept, lambda _, v: scrub_text(v))
    return F.when(F.size(clean) > 0, clean)


def capture_response(
    df: DataFrame, body: str = "body", error: str = "error", headers: str = "headers",
    content_max: int = 0, reasoning_max: int = 0,
) -> DataFrame:
    """Adds the response fields of the first choice, or only error and headers.

    Previews come from the scrubbed text before any cap.  The `has_*` flags are
    NULL where the answer holds no choice.
    """
    parsed = df.withColumn("__b", F.from_json(F.col(body), RESPONSE_BODY))
    failed = blank_to_null(F.col(error)).isNotNull()
    msg = F.try_element_at(F.col("__b.choices"), F.lit(1))["message"]
    answered = ~failed & (F.size("__b.choices") > 0)
    raw_reasoning = F.coalesce(blank_to_null(msg["reasoning_content"]), blank_to_null(msg["reasoning"]))
    content = scrub_text(F.coalesce(msg["content"], F.lit("")))
    reasoning = scrub_text(F.coalesce(raw_reasoning, F.lit("")))
    calls = F.to_json(
        F.transform(
            msg["tool_calls"],
            lambda c: F.struct(
                c["function"]["name"].alias("name"),
                F.coalesce(c["function"]["arguments"], F.lit("")).alias("arguments"),
            ),
        )
    )
    has_calls = F.coalesce(F.size(msg["tool_calls"]) > 0, F.lit(False))

    def when_answered(c: Column) -> Column:
        return F.when(answered, c)

    staged = parsed.select(
        *df.columns,
        when_answered(blank_to_null(msg["content"]).isNotNull()).alias("has_content"),
        when_answered(has_calls).alias("has_tool_calls"),
        when_answered(raw_reasoning.isNotNull()).alias("has_reasoning_content"),
        when_answered(content).alias("__content"),
        when_answered(reasoning).alias("__reasoning"),
        when_answered(F.when(has_calls, calls)).alias("__calls"),
        F.when(~failed, F.col("__b.usage")).alias("tokens"),
        F.when(failed, header_allowlist(F.col(headers))).alias("upstream_headers"),
    )

    def kept(name: str, limit: int) -> Column:
        return F.when(F.col(name).isNotNull(), cap(F.col(name), limit))

    return staged.select(
        *df.columns,
        "has_content", "has_tool_calls", "has_reasoning_content",
        kept("__content", content_max).alias("content"),
        kept("__reasoning", reasoning_max).alias("reasoning_content"),
        F.left("__content", F.lit(PREVIEW_CHARS)).alias("content_preview"),
        F.left("__reasoning", F.lit(PREVIEW_CHARS)).alias("reasoning_content_preview"),
        scrub_json(F.col("__calls")).alias("tool_calls"),
        "tokens", "upstream_headers",
    )


def prompt_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def prompt_dictionary(exchanges: DataFrame, messages: str = "messages") -> DataFrame:
    """One row per system prompt: hash, body, and the first request that carried it.

    The same prompt is sent with most requests, so this is an aggregate that
    combines before the shuffle rather than a ranking of all its rows.
    """
    sent = exchanges.select("ts", "request_id", F.explode(_said_by(F.col(messages), "system")).alias("m")).where(
        F.col("m.content").isNotNull()
    )
    first = F.min(F.struct("ts", "request_id")).alias("first")
    return (
        sent.groupBy(prompt_hash(F.col("m.content")).alias("system_sha256"))
        .agg(first, F.min("m.content").alias("body"))
        .select(
            "system_sha256",
            F.col("first.ts").alias("first_ts"),
            F.col("first.request_id").alias("first_request_id"),
            scrub_text(F.col("body")).alias("content"),
        )
    )


def reference_prompts(df: DataFrame, messages: str = "messages") -> DataFrame:
    """`messages` with system prompts replaced by their hash and length."""

    def refer(m: Column) -> Column:
        is_prompt = (m["role"] == "system") & m["content"].isNotNull()
        return F.struct(
            m["role"].alias("role"),
            F.when(~is_prompt, scrub_text(m["content"])).alias("content"),
            m["tool_call_id"].alias("tool_call_id"),
            F.when(is_prompt, prompt_hash(m["content"])).alias("system_sha256"),
            F.when(is_prompt, F.length(m["content"])).alias("content_len"),
        )

    return df.withColumn(messages, F.transform(F.col(messages), refer))


def rehydrate_prompts(
    referenced: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("request_id",), messages: str = "messages"
) -> DataFrame:
    """Hash references replaced by the prompt bodies again.

    Only the references are joined, as one small row each, and only requests
    that hold one are regrouped; the messages themselves are not exploded.
    The regrouping is per request, whose array it came from.  A request id may
    occur more than once: the rows that share it share one map of their prompts.
    """
    wanted = referenced.select(
        *key, F.explode(F.array_distinct(F.transform(F.filter(messages, lambda m: m["system_sha256"].isNotNull()), lambda m: m["system_sha256"]))).alias("system_sha256")
    ).distinct()
    bodies = (
        wanted.join(dictionary.select("system_sha256", F.col("content").alias("body")), "system_sha256")
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("system_sha256", "body"))).alias("__bodies"))
    )

    def fill(m: Column) -> Column:
        body = F.try_element_at(F.col("__bodies"), m["system_sha256"])
        return F.struct(
            m["role"].alias("role"),
            F.coalesce(m["content"], body).alias("content"),
            m["tool_call_id"].alias("tool_call_id"),
        )

    return (
        referenced.join(bodies, list(key), "left")
        .withColumn(messages, F.transform(F.col(messages), fill))
        .drop("__bodies")
    )
