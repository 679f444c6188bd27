"""One row per session: identity, cost, latency and how the session ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import count_if, jlen, seconds_between, to_bigint, to_double
from logloom.functions.text import app_of, is_budget_error, run_tag_of
from logloom.operators.flatten import fill_missing
from logloom.operators.turns import SCOPES
from logloom.schemas import ROLLUP_COLUMNS, ROLLUP_INPUTS, TOKENS_TEXT


def token_columns(tokens: Column) -> dict[str, Column]:
    """Typed token counts and cost out of a usage document, which is parsed once."""
    doc = F.from_json(tokens, TOKENS_TEXT)
    return {
        "prompt_tokens": to_bigint(doc["prompt_tokens"]),
        "completion_tokens": to_bigint(doc["completion_tokens"]),
        "cached_tokens": to_bigint(doc["prompt_tokens_details"]["cached_tokens"]),
        "total_tokens": to_bigint(doc["total_tokens"]),
        "cost": to_double(doc["cost"]),
    }


def end_status(response_ts: Column, error: Column) -> Column:
    """How a session ended, from its last turn.

    A turn nothing came back for has no error either, so `incomplete` is tested
    before `ok`.
    """
    return (
        F.when(response_ts.isNull(), F.lit("incomplete"))
        .when(error.isNull(), F.lit("ok"))
        .when(error.ilike("%timed out%"), F.lit("timeout"))
        .when(is_budget_error(error), F.lit("budget_capped"))
        .otherwise(F.lit("error"))
    )


def session_rollup(turns: DataFrame, scope: str | None = None) -> DataFrame:
    """The 28 session columns.

    Two mergeable aggregation steps: first per (session, model), which combines
    before the shuffle and spreads a huge session over its models, then per
    session.  First turn, last turn and last answer are the least or greatest of
    a struct that starts with the turn's position, so no ranking is needed.
    With `scope` the table's `period` column is part of the key.
    """
    if scope is not None and scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, not {scope!r}")
    keys = ["session_key"] if scope is None else ["session_key", "period"]
    wanted = dict(ROLLUP_INPUTS)
    if scope is not None:
        wanted["period"] = "string"
    t = fill_missing(turns, wanted)
    t = t.select("*", *[c.alias(f"__{n}") for n, c in token_columns(F.col("tokens")).items()])

    # Turns without a time come last in both directions.
    forward = [F.col("request_ts").isNull().alias("undated"), F.col("request_ts"), F.col("turn_idx"), F.col("response_ts")]
    backward = [F.col("request_ts").isNotNull().alias("dated"), F.col("request_ts"), F.col("turn_idx"), F.col("response_ts")]
    launch = F.struct(
        *forward, "origin", "client", "model", "provider",
        F.coalesce(F.col("user_message_this_turn"), F.col("user_question")).alias("question"),
    )
    closing = F.struct(*backward, "error")
    answer = F.struct(*backward, "assistant_content")
    last_seen = F.coalesce(F.col("response_ts"), F.col("request_ts"))

    per_model = t.groupBy(*keys, F.col("model").alias("__m")).agg(
        F.max("session_id").alias("session_id"),
        F.min(launch).alias("first_turn"),
        F.max(closing).alias("last_turn"),
        F.max(F.when(F.col("assistant_content") != "", answer)).alias("last_answer"),
        F.count("*").alias("turns"),
        F.sum(jlen("tool_calls")).alias("tool_calls_total"),
        *[F.sum(f"__{n}").alias(n) for n in ("prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens")],
        F.sum("__cost").alias("cost_usd"),
        F.count("__cost").alias("cost_turns"),
        F.sum("latency_ms").alias("llm_ms_total"),
        count_if(F.col("error").isNotNull()).alias("error_turns"),
        count_if(F.col("response_ts").isNull()).alias("unanswered_turns"),
        F.min("request_ts").alias("started_at"),
        F.max(last_seen).alias("finished_at"),
    )
    totals = (
        "turns", "tool_calls_total", "prompt_tokens", "completion_tokens", "cached_tokens",
        "total_tokens", "cost_usd", "cost_turns", "llm_ms_total", "error_turns", "unanswered_turns",
    )
    s = per_model.groupBy(*keys).agg(
        F.max("session_id").alias("session_id"),
        F.min("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
        F.max("last_answer").alias("last_answer"),
        F.count("__m").alias("models_used"),
        *[F.sum(n).alias(n) for n in totals],
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
    )
    first, last = F.col("first_turn"), F.col("last_turn")
    out = {
        "session_key_synthetic": F.col("session_key").startswith("anon:"),
        "origin": first["origin"],
        "app": app_of(first["origin"]),
        "run_tag": run_tag_of(first["origin"]),
        "client": first["client"],
        "model": first["model"],
        "provider": first["provider"],
        "question": first["question"],
        "wall_clock_s": seconds_between("started_at", "finished_at"),
        "status": end_status(last["response_ts"], last["error"]),
        "final_error": last["error"],
        "final_answer": F.col("last_answer")["assistant_content"],
    }
    columns = [out[n].alias(n) if n in out else F.col(n) for n in ROLLUP_COLUMNS]
    return s.select(*keys[1:], *columns)


def tier_compare(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Day-scoped against month-scoped sessions: turn and token totals must agree."""

    def totals(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("session_key").agg(
            F.count("*").alias(f"{tag}_rows"),
            F.sum("turns").alias(f"{tag}_turns"),
            F.sum("total_tokens").alias(f"{tag}_tokens"),
        )

    return (
        totals(daily, "daily")
        .join(totals(monthly, "monthly"), "session_key", "left")
        .select(
            "session_key", "daily_rows", "monthly_rows", "daily_turns", "monthly_turns",
            (
                (F.col("daily_turns") == F.col("monthly_turns"))
                & F.col("daily_tokens").eqNullSafe(F.col("monthly_tokens"))
            ).alias("totals_agree"),
        )
    )
