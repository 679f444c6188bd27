"""Requests paired with their responses: the turn table and related joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import jstr, spread_nulls
from logloom.operators.flatten import upgrade_schema
from logloom.operators.ordering import next_event, position, time_bucket
from logloom.schemas import TURN_COLUMNS

SCOPES = ("day", "month")


def session_key(session_id: Column, origin: Column, user_question: Column) -> Column:
    """Session id, or a hash of origin and opening question where there is none."""
    seed = F.concat(F.coalesce(origin, F.lit("")), F.lit("|"), F.coalesce(user_question, F.lit("")))
    return F.coalesce(session_id, F.concat(F.lit("anon:"), F.md5(seed)))


def _period(ts: Column, scope: str) -> Column:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")
    text = F.date_format(ts, "yyyy-MM-dd" if scope == "day" else "yyyy-MM")
    return F.coalesce(text, F.lit("undated"))


def index_turns(requests: DataFrame, scope: str = "month") -> DataFrame:
    """1-based turn index per session within the period, by (ts, request_id).

    Synthetic keys collect every repeat of a question and may be huge, hence
    the bucketed numbering instead of one window per session.
    """
    keyed = requests.withColumn("period", _period(F.col("ts"), scope))
    order = [F.col("ts").asc_nulls_last(), F.col("request_id").asc_nulls_last()]
    return position(keyed, ["session_key", "period"], order, time_bucket(F.col("ts")), "turn_idx")


def pair_turns(entries: DataFrame, scope: str = "month", nearest: bool = False) -> DataFrame:
    """One row per request with its response, if any.

    The index is given before the join, so a response logged twice repeats the
    turn and does not renumber the session.  Responses without a request do not
    appear.  Takes legacy or wide entries.

    Request ids are short and may collide: n requests and m responses that share one give n x m rows.
    With `nearest` a request takes the first response of its id that is not earlier than itself, and
    there is one row per request.  Of several responses at that instant the one with the least entry counts.
    """
    wide = upgrade_schema(entries)
    requests = wide.where(F.col("type") == "request").select(
        session_key(F.col("session_id"), F.col("origin"), F.col("user_question")).alias("session_key"),
        "session_id", "ts", "request_id", "origin", "client", "provider", "model", "user_question",
        "user_message_this_turn", "message_count", "enable_thinking", "tool_results",
    )
    responses = wide.where((F.col("type") == "response") & F.col("request_id").isNotNull()).select(
        "entry",
        F.col("request_id").alias("__rid"),
        F.col("ts").alias("response_ts"),
        jstr("entry", "$.content").alias("assistant_content"),
        jstr("entry", "$.reasoning_content").alias("reasoning_content"),
        "tool_calls", "has_tool_calls", "has_content", "latency_ms", "tokens", "error",
    )
    indexed = index_turns(requests, scope).withColumnRenamed("ts", "request_ts")
    if nearest:
        return _pair_nearest(indexed, responses).select("period", *TURN_COLUMNS)
    paired = indexed.join(
        responses,
        spread_nulls("request_id", "session_key", "request_ts") == F.col("__rid"),
        "left",
    )
    return paired.select("period", *TURN_COLUMNS)


def _pair_nearest(indexed: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the nearest later response; only times are compared before the join that brings the text."""
    times = responses.select(F.col("__rid").alias("request_id"), F.col("response_ts").alias("request_ts"))
    timed = next_event(indexed, times, "request_id", "request_ts", "__answered")
    rest = [c for c in responses.columns if c not in ("__rid", "response_ts", "entry")]
    one = responses.groupBy("__rid", "response_ts").agg(F.min(F.struct("entry", *rest)).alias("__r"))
    on = (spread_nulls("request_id", "session_key", "request_ts") == F.col("__rid")) & (F.col("__answered") == F.col("response_ts"))
    return timed.join(one.select("__rid", "response_ts", "__r.*"), on, "left")


def pair_inner(entries: DataFrame) -> DataFrame:
    """Answered requests only: question, tool calls and latency per pair."""
    wide = upgrade_schema(entries)
    req = wide.where(F.col("type") == "request").select("ts", "request_id", "user_question")
    resp = wide.where(F.col("type") == "response").select("request_id", "tool_calls", "latency_ms")
    return req.join(resp, "request_id", "inner")


def live_union(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored history plus the live rows whose request is not stored yet.

    Live rows without a request id are left out: they cannot be told apart from
    stored ones.
    """
    known = stored.where(F.col("request_id").isNotNull()).select("request_id")
    fresh = live.where(F.col("request_id").isNotNull()).join(known, "request_id", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def union_tiers(*parts: DataFrame) -> DataFrame:
    """Tiers of different ages by column name; a column a part lacks is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def replay_session(turns: DataFrame, key: str) -> DataFrame:
    """All turns of one session in order, with result and call counts."""
    return (
        turns.where(F.col("session_key") == key)
        .select(
            "turn_idx", "model", "user_message_this_turn",
            F.json_array_length("tool_results").cast("bigint").alias("results_in"),
            F.json_array_length("tool_calls").cast("bigint").alias("calls_out"),
            "assistant_content", "latency_ms", "response_ts",
        )
        .orderBy("turn_idx", "response_ts")
        .drop("response_ts")
    )


def find_sessions(turns: DataFrame, limit: int = 20) -> DataFrame:
    """First turns in session order, to look up a key."""
    return (
        turns.select("session_key", "turn_idx", "user_message_this_turn", "request_id")
        .orderBy("session_key", "turn_idx", "request_id")
        .limit(limit)
    )
