"""Registration of a query together with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.fixtures import written_once  # noqa: F401
from logloom.session import ship, use_small_splits, use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers fn(spark, sf_dir) under a name, with its checking SQL if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_small_splits(use_utc(ship(spark))), sf_dir)

        run.__module_of__ = fn.__module__.rpartition(".")[2]
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone, as the checking engine holds them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


# ---- common table expressions of the checking SQL --------------------------

LOG = f"log_lines AS ({fx.LOG_LINES})"

# Field names of the log records and columns of the tiers.
FLAT_COLUMNS = """
  json_extract_string(entry, '$.session_id') AS session_id, origin,
  json_extract_string(entry, '$.client') AS client,
  json_extract_string(entry, '$.provider') AS provider,
  json_extract_string(entry, '$.model') AS model,
  try_cast(json_extract_string(entry, '$.message_count') AS integer) AS message_count,
  try_cast(json_extract_string(entry, '$.tools_count') AS integer) AS tools_count,
  try_cast(json_extract_string(entry, '$.enable_thinking') AS boolean) AS enable_thinking,
  json_extract_string(entry, '$.user_question') AS user_question,
  json_extract_string(entry, '$.user_message_this_turn') AS user_message_this_turn,
  try_cast(json_extract_string(entry, '$.latency_ms') AS bigint) AS latency_ms,
  try_cast(json_extract_string(entry, '$.has_tool_calls') AS boolean) AS has_tool_calls,
  try_cast(json_extract_string(entry, '$.has_content') AS boolean) AS has_content,
  nullif(cast(json_extract(entry, '$.tool_calls') AS varchar), 'null') AS tool_calls,
  nullif(cast(json_extract(entry, '$.tool_results_this_turn') AS varchar), 'null') AS tool_results,
  nullif(cast(json_extract(entry, '$.tokens') AS varchar), 'null') AS tokens,
  json_extract_string(entry, '$.error') AS error
"""
FLAT = f"flat AS (SELECT ts, day, path, type, request_id, {FLAT_COLUMNS}, entry FROM log_lines)"


def turn_ctes(scope: str) -> tuple[str, ...]:
    """Turn table as the checking engine builds it, from a plain window and a join."""
    period = "strftime(ts, '%Y-%m-%d')" if scope == "day" else "strftime(ts, '%Y-%m')"
    return (
        LOG,
        FLAT,
        f"""asked AS (
          SELECT f.*, {period} AS period,
            CASE WHEN session_id IS NULL THEN concat('anon:', md5(concat(coalesce(origin, ''), '|', coalesce(user_question, '')))) ELSE session_id END AS session_key
          FROM flat f WHERE type = 'request')""",
        """numbered AS (
          SELECT *, row_number() OVER (PARTITION BY session_key, period ORDER BY ts, request_id) AS turn_idx FROM asked)""",
        """turns AS (
          SELECT n.period, n.session_key, n.session_id, n.turn_idx, n.ts AS request_ts, r.ts AS response_ts, n.request_id, n.origin,
            n.client, n.provider, n.model, n.user_question, n.user_message_this_turn, n.message_count, n.enable_thinking, n.tool_results,
            json_extract_string(r.entry, '$.content') AS assistant_content, json_extract_string(r.entry, '$.reasoning_content') AS reasoning_content,
            r.tool_calls, r.has_tool_calls, r.has_content, r.latency_ms, r.tokens, r.error
          FROM numbered n LEFT JOIN flat r ON r.request_id = n.request_id AND r.type = 'response')""",
    )


def rollup_ctes(scope: str) -> tuple[str, ...]:
    """Session rollup from ranked turns; the key is (session_key, period)."""
    return (
        *turn_ctes(scope),
        """tt AS (
          SELECT *, try_cast(json_extract_string(tokens, '$.prompt_tokens') AS bigint) AS pt,
            try_cast(json_extract_string(tokens, '$.completion_tokens') AS bigint) AS ct,
            try_cast(json_extract_string(tokens, '$.total_tokens') AS bigint) AS tot,
            try_cast(json_extract_string(tokens, '$.prompt_tokens_details.cached_tokens') AS bigint) AS cached,
            try_cast(json_extract_string(tokens, '$.cost') AS double) AS cost,
            coalesce(json_array_length(tool_calls), 0) AS calls
          FROM turns)""",
        """opening AS (
          SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY session_key, period ORDER BY request_ts, turn_idx, response_ts) = 1)""",
        """closing AS (
          SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY session_key, period ORDER BY request_ts DESC, turn_idx DESC, response_ts DESC) = 1)""",
        """answered AS (
          SELECT * FROM tt WHERE assistant_content <> ''
          QUALIFY row_number() OVER (PARTITION BY session_key, period ORDER BY request_ts DESC, turn_idx DESC, response_ts DESC) = 1)""",
        """sums AS (
          SELECT session_key, period, max(session_id) AS session_id, count(DISTINCT model) AS models_used, count(*) AS turns,
            cast(sum(calls) AS bigint) AS tool_calls_total, cast(sum(pt) AS bigint) AS prompt_tokens, cast(sum(ct) AS bigint) AS completion_tokens,
            cast(sum(cached) AS bigint) AS cached_tokens, cast(sum(tot) AS bigint) AS total_tokens, sum(cost) AS cost_usd, count(cost) AS cost_turns,
            cast(sum(latency_ms) AS bigint) AS llm_ms_total, count(error) AS error_turns, count(*) - count(response_ts) AS unanswered_turns,
            min(request_ts) AS started_at, max(coalesce(response_ts, request_ts)) AS finished_at
          FROM tt GROUP BY session_key, period)""",
        """rollup AS (
          SELECT s.period, s.session_key, s.session_id, starts_with(s.session_key, 'anon:') AS session_key_synthetic, o.origin,
            regexp_extract(o.origin, '^https?://([^./:]+)', 1) AS app, nullif(regexp_extract(o.origin, '^https?://[^/]+(/.*)$', 1), '') AS run_tag,
            o.client, o.model, o.provider, s.models_used, coalesce(o.user_message_this_turn, o.user_question) AS question, s.turns, s.tool_calls_total,
            s.prompt_tokens, s.completion_tokens, s.cached_tokens, s.total_tokens, s.cost_usd, s.cost_turns, s.llm_ms_total,
            cast(date_diff('ms', s.started_at, s.finished_at) AS double) / 1000 AS wall_clock_s, s.error_turns, s.unanswered_turns,
            CASE WHEN c.response_ts IS NULL THEN 'incomplete' WHEN c.error IS NULL THEN 'ok'
              WHEN lower(c.error) LIKE '%timed out%' THEN 'timeout'
              WHEN regexp_matches(lower(c.error), 'budget limit exceeded|credit balance is too low|requires more credits') THEN 'budget_capped'
              ELSE 'error' END AS status,
            c.error AS final_error, a.assistant_content AS final_answer, s.started_at, s.finished_at
          FROM sums s JOIN opening o USING (session_key, period) JOIN closing c USING (session_key, period)
          LEFT JOIN answered a USING (session_key, period))""",
    )
