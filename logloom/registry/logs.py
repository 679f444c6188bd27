"""Queries over log entries, turns and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.functions.text import app_of, classify_error, run_tag_of
from logloom.operators import quality, sessions, stats, turns
from logloom.operators.flatten import fill_missing, flatten_entries, upgrade_schema
from logloom.plans.lifecycle import counts_match
from logloom.registry.base import FLAT, LOG, ntz, query, rollup_ctes, turn_ctes, with_ctes, written_once
from logloom.schemas import ROLLUP_INPUTS, WIDE_COLUMNS
from logloom.session import shared_dir
from logloom.sources import raw, tiers

WIDE_SQL = ", ".join(WIDE_COLUMNS)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_entries(fx.legacy_entries(spark, sf_dir))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).where(F.col("type") == "response")


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide tier as the pipeline leaves it."""
    return fx.stored(spark, sf_dir, "wide-tier", lambda: _wide(spark, sf_dir), deal=False)


def _turns(spark: SparkSession, sf_dir: str, scope: str = "month") -> DataFrame:
    return turns.pair_turns(_consolidated(spark, sf_dir), scope)


def _rollup(spark: SparkSession, sf_dir: str, scope: str = "month") -> DataFrame:
    return sessions.session_rollup(_turns(spark, sf_dir, scope), scope)


def _stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn tier as the pipeline leaves it; session reports start from it."""
    return fx.stored(spark, sf_dir, "turn-tier", lambda: _turns(spark, sf_dir), deal=False)


def _stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stored(
        spark, sf_dir, "session-tier", lambda: sessions.session_rollup(_stored_turns(spark, sf_dir), "month")
    )


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Writes the tiers the queries start from, so that timings leave them out."""
    _consolidated(spark, sf_dir)
    _stored_rollup(spark, sf_dir)


# ---- flattening and schema upkeep ------------------------------------------


@query("flatten_entries", with_ctes(LOG, FLAT, body=f"SELECT {WIDE_SQL} FROM flat"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.log_lines(spark, sf_dir).select("entry")
    return ntz(flatten_entries(lines).select(*WIDE_COLUMNS), "ts")


@query("upgrade_schema", with_ctes(LOG, FLAT, body=f"SELECT {WIDE_SQL} FROM flat"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = fx.legacy_entries(spark, sf_dir).withColumn("model", F.lit("stale"))
    return upgrade_schema(upgrade_schema(stale))


@query(
    "fill_missing",
    with_ctes(
        *turn_ctes("month"),
        body="""SELECT session_key, session_id, turn_idx, request_ts, response_ts, origin, client, provider, model, user_question,
          cast(NULL AS varchar) AS user_message_this_turn, assistant_content, tool_calls, latency_ms, tokens, error FROM turns""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _turns(spark, sf_dir).drop("user_message_this_turn")
    return fill_missing(old, ROLLUP_INPUTS)


@query(
    "union_by_name",
    with_ctes(
        LOG, FLAT,
        body="""SELECT ts, type, request_id, origin, CASE WHEN day < '2024-01-10' THEN NULL ELSE model END AS model,
          CASE WHEN day < '2024-01-10' THEN NULL ELSE latency_ms END AS latency_ms, entry FROM flat""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old five-column days and newer wide days, stored as files and read together."""
    lines = fx.log_lines(spark, sf_dir)

    def write(path: str) -> None:
        old = lines.where(F.col("day") < "2024-01-10").select("ts", "type", "request_id", "origin", "entry")
        old.write.parquet(f"{path}/old")
        new = lines.where(F.col("day") >= "2024-01-10").select("ts", "type", "request_id", "origin", "entry")
        flatten_entries(new).write.parquet(f"{path}/new")

    path = written_once(spark, sf_dir, "mixed", write)
    mixed = tiers.read_mixed(spark, f"{path}/old", f"{path}/new")
    return mixed.select("ts", "type", "request_id", "origin", "model", "latency_ms", "entry")


def _chunks(spark: SparkSession, sf_dir: str) -> str:
    """Log lines as JSONL below day folders, with a broken and a blank line per error entry."""

    def write(path: str) -> None:
        lines = fx.log_lines(spark, sf_dir).select(F.col("day").alias("d"), F.col("entry").alias("value"), "request_id", "type")
        broken = lines.where(F.col("value").contains('"error":')).withColumn("value", F.substring("value", 1, 40))
        blank = broken.withColumn("value", F.lit("  "))
        lines.unionByName(broken).unionByName(blank).select("d", "value").write.partitionBy("d").text(path)

    return written_once(spark, sf_dir, "chunks", write)


@query("read_raw", with_ctes(LOG, body="SELECT entry FROM log_lines UNION ALL SELECT substr(entry, 1, 40) FROM log_lines WHERE contains(entry, '\"error\":')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.read_raw(spark, _chunks(spark, sf_dir)).select("entry")


@query("tolerant_read", with_ctes(LOG, body="SELECT entry FROM log_lines"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = raw.read_raw_tolerant(spark, _chunks(spark, sf_dir))
    return good.select("entry")


@query("quarantine", with_ctes(LOG, body="SELECT substr(entry, 1, 40) AS entry FROM log_lines WHERE contains(entry, '\"error\":')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = raw.read_raw_tolerant(spark, _chunks(spark, sf_dir))
    return bad.select("entry")


@query(
    "typed_read",
    with_ctes(LOG, FLAT, body="SELECT request_id, type, model, error, latency_ms, cast(NULL AS varchar) AS region FROM flat"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "request_id string, type string, model string, error string, latency_ms bigint, region string"

    def write(path: str) -> None:
        fx.log_lines(spark, sf_dir).select(F.col("entry").alias("value")).write.text(path)

    return raw.read_raw_typed(spark, schema, written_once(spark, sf_dir, "typed", write))


@query(
    "hour_prune",
    with_ctes(LOG, body="SELECT path, entry FROM log_lines WHERE path LIKE '2024-01-17/14-%'"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fx.log_lines(spark, sf_dir).select(
        "path", "entry", raw.chunk_day(F.col("path")).alias("log_day"), raw.chunk_hour(F.col("path")).alias("log_hour")
    )
    return raw.in_hour(named, "2024-01-17", 14).select("path", "entry")


@query("write_tier", with_ctes(LOG, FLAT, body=f"SELECT {WIDE_SQL} FROM flat"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "written-tier")  # written at every call
    tiers.write_tier(_wide(spark, sf_dir), path)
    return tiers.read_partitioned(spark, path).select(*WIDE_COLUMNS)


@query(
    "read_tier",
    with_ctes(LOG, FLAT, body="SELECT day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM flat WHERE day >= '2024-01-10' AND day <= '2024-01-19' GROUP BY day"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_once(spark, sf_dir, "tier", lambda p: tiers.write_tier(_wide(spark, sf_dir), p))
    days = tiers.read_partitioned(spark, path).where(F.col("log_date").between("2024-01-10", "2024-01-19"))
    return days.groupBy(F.date_format("log_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "rewrite_in_place",
    with_ctes(LOG, FLAT, body="SELECT ts, request_id, type, CASE WHEN error IS NULL THEN NULL ELSE '[gone]' END AS error FROM flat"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_once(spark, sf_dir, "rewritten", lambda p: tiers.write_tier(_wide(spark, sf_dir), p))
    tiers.rewrite_in_place(spark, path, lambda df: df.withColumn("error", F.when(F.col("error").isNotNull(), "[gone]")))
    return spark.read.parquet(path).select("ts", "request_id", "type", "error")


@query(
    "counts_match",
    with_ctes(LOG, body="SELECT day, count(*) AS rows_before, count(*) AS rows_after, true AS ok FROM log_lines GROUP BY day"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table against its rewrite in place."""
    before = fx.log_lines(spark, sf_dir)
    path = shared_dir(spark, "rewritten-lines")
    tiers.write_tier(before, path, day=F.to_date("day"))
    tiers.rewrite_in_place(spark, path, lambda df: df.withColumn("entry", F.upper("entry")))
    return counts_match(before, spark.read.parquet(path).withColumn("day", F.date_format("log_date", "yyyy-MM-dd")), "day")


@query(
    "counts_differ",
    with_ctes(
        LOG,
        body="""SELECT day, count(*) AS rows_before, nullif(count(*) FILTER (WHERE type <> 'system_prompt' AND day <> '2024-01-12'), 0) AS rows_after,
          coalesce(count(*) = nullif(count(*) FILTER (WHERE type <> 'system_prompt' AND day <> '2024-01-12'), 0), false) AS ok FROM log_lines GROUP BY day""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite that has lost rows, and one whole day, is told apart day by day."""
    before = fx.log_lines(spark, sf_dir)
    path = shared_dir(spark, "lossy-lines")
    tiers.write_tier(before.where("type <> 'system_prompt' AND day <> '2024-01-12'"), path, day=F.to_date("day"))
    return counts_match(before, spark.read.parquet(path).withColumn("day", F.date_format("log_date", "yyyy-MM-dd")), "day")


# ---- turns -----------------------------------------------------------------


@query("turns_monthly", with_ctes(*turn_ctes("month"), body="SELECT * FROM turns"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "month")


@query("turns_daily", with_ctes(*turn_ctes("day"), body="SELECT * FROM turns"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "day")


@query("turns_legacy", with_ctes(*turn_ctes("month"), body="SELECT * FROM turns"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the five-column tables, whose columns are all still inside the entry."""
    return turns.pair_turns(fx.legacy_entries(spark, sf_dir), "month")


_NEAREST = """near AS (
  SELECT n.period, n.session_key, n.session_id, n.turn_idx, n.ts AS request_ts, r.ts AS response_ts, n.request_id, n.origin,
    n.client, n.provider, n.model, n.user_question, n.user_message_this_turn, n.message_count, n.enable_thinking, n.tool_results,
    json_extract_string(r.entry, '$.content') AS assistant_content, json_extract_string(r.entry, '$.reasoning_content') AS reasoning_content,
    r.tool_calls, r.has_tool_calls, r.has_content, r.latency_ms, r.tokens, r.error
  FROM numbered n LEFT JOIN LATERAL (
    SELECT * FROM flat f WHERE f.type = 'response' AND f.request_id = n.request_id AND f.ts >= n.ts ORDER BY f.ts, f.entry LIMIT 1) r ON true)"""


@query("turns_nearest", with_ctes(*turn_ctes("month")[:4], _NEAREST, body="SELECT * FROM near"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.pair_turns(_consolidated(spark, sf_dir), "month", nearest=True)


# Ids cut to their last three characters, so that requests and responses share them.
_SHORT = LOG.replace("log_lines AS (", "log_lines AS (SELECT * REPLACE (right(request_id, 3) AS request_id) FROM (", 1) + ")"


@query("turns_colliding_ids", with_ctes(_SHORT, *turn_ctes("month")[1:4], _NEAREST, body="SELECT * FROM near"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few ids, each shared by many requests: one row per request all the same."""
    short = _consolidated(spark, sf_dir).withColumn("request_id", F.substring("request_id", -3, 3))
    return turns.pair_turns(short, "month", nearest=True)


@query(
    "pair_inner",
    with_ctes(
        LOG, FLAT,
        body="""SELECT a.ts, a.request_id, a.user_question, b.tool_calls, b.latency_ms
          FROM flat a, flat b WHERE a.request_id = b.request_id AND a.type = 'request' AND b.type = 'response'""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.pair_inner(fx.legacy_entries(spark, sf_dir))


# Stored history lacks the last ten days; live lines overlap it by ten days.
_LIVE_SQL = """
stored AS (SELECT ts, type, request_id, model, error FROM flat WHERE day < '2024-01-20'),
live AS (SELECT ts, type, request_id, model, error FROM flat WHERE day >= '2024-01-10')
"""


@query(
    "live_union",
    with_ctes(
        LOG, FLAT, _LIVE_SQL,
        body="""SELECT * FROM stored UNION ALL SELECT l.* FROM live l
          WHERE l.request_id NOT IN (SELECT request_id FROM stored WHERE request_id IS NOT NULL)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir).select("ts", "type", "request_id", "model", "error")
    return turns.live_union(
        wide.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")),
        wide.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")),
    )


@query(
    "union_tiers",
    with_ctes(
        LOG, FLAT,
        body="""SELECT type, model, count(*) AS n, count(latency_ms) AS with_latency FROM (
          SELECT type, model, latency_ms FROM flat WHERE day < '2024-01-15'
          UNION ALL SELECT type, model, NULL FROM flat WHERE day >= '2024-01-15') u GROUP BY type, model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    both = turns.union_tiers(
        wide.where(F.col("ts") < split).select("type", "model", "latency_ms"),
        wide.where(F.col("ts") >= split).select("type", "model"),
    )
    return both.groupBy("type", "model").agg(F.count("*").alias("n"), F.count("latency_ms").alias("with_latency"))


@query(
    "replay_session",
    with_ctes(
        *turn_ctes("month"),
        body="""SELECT turn_idx, model, user_message_this_turn, cast(json_array_length(tool_results) AS bigint) AS results_in,
          cast(json_array_length(tool_calls) AS bigint) AS calls_out, assistant_content, latency_ms FROM turns WHERE session_key = 's7'""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.replay_session(_stored_turns(spark, sf_dir), "s7")


@query(
    "find_sessions",
    with_ctes(
        *turn_ctes("month"),
        body="SELECT session_key, turn_idx, user_message_this_turn, request_id FROM turns ORDER BY session_key, turn_idx, request_id LIMIT 20",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.find_sessions(_stored_turns(spark, sf_dir), 20)


# ---- sessions --------------------------------------------------------------


@query("session_rollup", with_ctes(*rollup_ctes("month"), body="SELECT * FROM rollup"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "month")


@query("session_rollup_daily", with_ctes(*rollup_ctes("day"), body="SELECT * FROM rollup"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "day")


@query(
    "session_status",
    with_ctes(*rollup_ctes("month"), body="SELECT status, count(*) AS sessions, cast(sum(turns) AS bigint) AS turns FROM rollup GROUP BY status"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_rollup(spark, sf_dir).groupBy("status").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))


@query("final_answer", with_ctes(*rollup_ctes("month"), body="SELECT session_key, final_answer, final_error FROM rollup"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_rollup(spark, sf_dir).select("session_key", "final_answer", "final_error")


@query(
    "token_cost",
    with_ctes(
        *rollup_ctes("month"),
        body="""SELECT provider, cast(sum(prompt_tokens) AS bigint) AS prompt_tokens, cast(sum(completion_tokens) AS bigint) AS completion_tokens,
          cast(sum(cached_tokens) AS bigint) AS cached_tokens, cast(sum(total_tokens) AS bigint) AS total_tokens, sum(cost_usd) AS cost_usd,
          cast(sum(cost_turns) AS bigint) AS cost_turns FROM rollup GROUP BY provider""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens", "cost_usd", "cost_turns")
    return _stored_rollup(spark, sf_dir).groupBy("provider").agg(*[F.sum(n).alias(n) for n in names])


@query(
    "tier_compare",
    with_ctes(
        LOG, FLAT,
        """keyed AS (SELECT f.*, strftime(ts, '%Y-%m-%d') AS d,
             coalesce(session_id, concat('anon:', md5(concat(coalesce(origin, ''), '|', coalesce(user_question, ''))))) AS session_key
           FROM flat f WHERE type = 'request')""",
        """t AS (SELECT k.session_key, k.d, try_cast(json_extract_string(r.tokens, '$.total_tokens') AS bigint) AS tok
           FROM keyed k LEFT JOIN flat r ON r.request_id = k.request_id AND r.type = 'response')""",
        body="""SELECT session_key, count(DISTINCT d) AS daily_rows, cast(1 AS bigint) AS monthly_rows, count(*) AS daily_turns,
          count(*) AS monthly_turns, true AS totals_agree FROM t GROUP BY session_key""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.tier_compare(_rollup(spark, sf_dir, "day"), _rollup(spark, sf_dir, "month"))


@query(
    "model_stats",
    with_ctes(
        *rollup_ctes("month"),
        body="""SELECT model, count(*) AS sessions, round(avg(turns), 1) AS calls_per_question, round(avg(wall_clock_s), 1) AS avg_seconds,
          round(sum(cost_usd), 2) AS usd, round(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*), 1) AS pct_ok
          FROM rollup WHERE NOT session_key_synthetic AND started_at > TIMESTAMP '2023-12-31' AND started_at <= TIMESTAMP '2024-01-14' GROUP BY model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("2024-01-14").cast("timestamp_ntz")
    recent = stats.in_window(_stored_rollup(spark, sf_dir), end - F.expr("INTERVAL 14 DAYS"), end, ts="started_at")
    return stats.model_stats(recent)


@query(
    "experiment_grid",
    with_ctes(
        *rollup_ctes("month"),
        body="""SELECT run_tag, model, count(*) AS sessions, round(avg(turns), 1) AS calls, count(*) FILTER (WHERE status <> 'ok') AS failures
          FROM rollup WHERE run_tag IS NOT NULL GROUP BY run_tag, model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.experiment_grid(_stored_rollup(spark, sf_dir))


@query(
    "by_origin",
    with_ctes(LOG, FLAT, body="SELECT origin, model, count(*) AS n FROM flat WHERE origin LIKE '%agent_runner_t1' GROUP BY origin, model"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_origin(_wide(spark, sf_dir), tag="agent_runner_t1").groupBy("origin", "model").agg(F.count("*").alias("n"))


@query(
    "in_window",
    with_ctes(LOG, FLAT, body="SELECT type, count(*) AS n, max(ts) AS last_ts FROM flat WHERE ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20' GROUP BY type"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the stored tier, so that the day partitions prune as well."""
    path = written_once(spark, sf_dir, "tier", lambda p: tiers.write_tier(_wide(spark, sf_dir), p))
    end = F.lit("2024-01-20").cast("timestamp_ntz")
    rows = stats.in_window(tiers.read_partitioned(spark, path), end - F.expr("INTERVAL 7 DAYS"), end, day="log_date")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query(
    "exclude_synthetic",
    with_ctes(*rollup_ctes("month"), body="SELECT session_key, turns, wall_clock_s FROM rollup WHERE NOT session_key_synthetic"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exclude_synthetic(_stored_rollup(spark, sf_dir)).select("session_key", "turns", "wall_clock_s")


@query(
    "tagged_origin",
    """SELECT url, regexp_extract(url, '^https?://([^./:]+)', 1) AS app, nullif(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), '') AS run_tag FROM pages""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("url", app_of(F.col("url")).alias("app"), run_tag_of(F.col("url")).alias("run_tag"))


# ---- operations ------------------------------------------------------------


def _balance_sql(width: str) -> str:
    return with_ctes(
        LOG,
        f"""w AS (SELECT time_bucket(INTERVAL {width}, ts) AS window_start, count(*) FILTER (WHERE type = 'request') AS requests,
              count(*) FILTER (WHERE type = 'response') AS responses FROM log_lines WHERE type IN ('request', 'response') GROUP BY 1)""",
        body="""SELECT window_start, requests, responses, round(cast(responses AS double) / nullif(requests, 0), 3) AS ratio,
          coalesce(requests >= 20 AND cast(responses AS double) / nullif(requests, 0) < 0.5, false) AS alarm FROM w""",
    )


@query("log_balance", _balance_sql("60 SECONDS"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_balance(fx.legacy_entries(spark, sf_dir))


@query("log_balance_6h", _balance_sql("6 HOURS"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_balance(fx.legacy_entries(spark, sf_dir), "6 hours")


@query(
    "failure_escalation",
    with_ctes(
        LOG, FLAT,
        """e AS (SELECT provider AS fn, ts, request_id, row_number() OVER (PARTITION BY provider ORDER BY ts, request_id) AS nth
           FROM flat WHERE type = 'response' AND error IS NOT NULL)""",
        body="SELECT fn, ts, request_id, nth FROM e WHERE nth IN (10, 100, 1000) OR (nth > 1000 AND nth % 1000 = 0)",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = _responses(spark, sf_dir).where(F.col("error").isNotNull()).select(F.col("provider").alias("fn"), "ts", "request_id")
    return stats.failure_escalation(failures).select("fn", "ts", "request_id", "nth")


@query(
    "timeout_clusters",
    with_ctes(
        LOG, FLAT,
        body="""SELECT provider, cast(floor(latency_ms / 1000) AS bigint) AS band, count(*) AS calls FROM flat
          WHERE type = 'response' AND error ILIKE '%timed out%' GROUP BY 1, 2""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timeout_clusters(_responses(spark, sf_dir))


@query(
    "slow_completions",
    with_ctes(LOG, FLAT, body="SELECT request_id, model, latency_ms FROM flat WHERE type = 'response' AND error IS NULL AND latency_ms > 60000"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slow_completions(_responses(spark, sf_dir), 60.0).select("request_id", "model", "latency_ms")


_CLASS_SQL = """CASE WHEN error IS NULL OR error = '' THEN NULL WHEN error ILIKE '%timed out%' THEN 'timeout'
  WHEN regexp_matches(error, 'returned [0-9]{3}') THEN concat('http_', regexp_extract(error, 'returned ([0-9]{3})', 1))
  WHEN error LIKE 'Client disconnected%' THEN 'disconnected' WHEN error LIKE '%API key not configured%' THEN 'not_configured'
  WHEN error LIKE 'Unknown model %' THEN 'unrouted' WHEN error LIKE 'Streaming is not supported%' THEN 'streaming_unsupported' ELSE 'connection' END"""


@query("classify_error", with_ctes(LOG, FLAT, body=f"SELECT request_id, ts, error, {_CLASS_SQL} AS error_class FROM flat WHERE type = 'response'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("request_id", "ts", "error", classify_error(F.col("error")).alias("error_class"))


@query(
    "error_classes",
    with_ctes(
        LOG, FLAT, f"c AS (SELECT provider, {_CLASS_SQL} AS error_class FROM flat WHERE type = 'response')",
        body="SELECT provider, error_class, count(*) AS calls FROM c WHERE error_class IS NOT NULL GROUP BY 1, 2",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.error_classes(_responses(spark, sf_dir))


@query(
    "tool_load",
    with_ctes(
        LOG, FLAT,
        """n AS (SELECT json_extract_string(c.value, '$.name') AS name FROM flat f, json_each(f.tool_calls) c WHERE f.type = 'response' AND f.tool_calls IS NOT NULL)""",
        body="""SELECT name, cast(sum(d) AS bigint) AS direct_calls, cast(count(*) AS bigint) AS effective_calls FROM (
          SELECT name, 1 AS d FROM n UNION ALL SELECT 'get_stac_details', 0 FROM n WHERE name = 'get_schema') x GROUP BY name""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tool_load(_responses(spark, sf_dir))


@query(
    "dialect_leak_rate",
    with_ctes(
        LOG, FLAT,
        "d AS (SELECT model, coalesce(try_cast(json_extract_string(entry, '$.tool_call_dialect_repaired') AS bigint), 0) AS n FROM flat WHERE type = 'response')",
        body="""SELECT model, count(*) AS responses, count(*) FILTER (WHERE n > 0) AS repaired_responses, cast(sum(n) AS bigint) AS repaired_args,
          round(cast(count(*) FILTER (WHERE n > 0) AS double) / count(*), 6) AS leak_rate FROM d GROUP BY model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dialect_leak_rate(_responses(spark, sf_dir))


_THINKING_SQL = """SELECT model, coalesce(cast(enable_thinking AS varchar), 'unset') AS requested, count(*) AS turns,
  count(*) FILTER (WHERE reasoning_content <> '') AS with_reasoning, quantile_cont(latency_ms, 0.5) AS median_latency_ms
  FROM turns WHERE response_ts IS NOT NULL GROUP BY 1, 2"""


@query("thinking_matrix", with_ctes(*turn_ctes("month"), body=_THINKING_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.thinking_matrix(_stored_turns(spark, sf_dir))


@query(
    "reasoning_effect",
    with_ctes(
        *turn_ctes("month"), f"m AS ({_THINKING_SQL})",
        body="""SELECT model, max(median_latency_ms) FILTER (WHERE requested = 'true') AS median_on_ms,
          max(median_latency_ms) FILTER (WHERE requested = 'false') AS median_off_ms FROM m GROUP BY model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reasoning_effect(stats.thinking_matrix(_stored_turns(spark, sf_dir)))


@query(
    "orphan_audit",
    with_ctes(
        LOG,
        "i AS (SELECT request_id, count(*) FILTER (WHERE type = 'request') AS q, count(*) FILTER (WHERE type = 'response') AS r FROM log_lines GROUP BY 1)",
        body="""SELECT (SELECT count(*) FROM log_lines l WHERE type = 'request' AND NOT EXISTS (SELECT 1 FROM log_lines x WHERE x.request_id = l.request_id AND x.type = 'response')) AS unanswered_requests,
          (SELECT count(*) FROM log_lines l WHERE type = 'response' AND NOT EXISTS (SELECT 1 FROM log_lines x WHERE x.request_id = l.request_id AND x.type = 'request')) AS orphan_responses,
          (SELECT count(*) FROM i WHERE q > 1 OR r > 1) AS repeated_ids""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphan_audit(fx.legacy_entries(spark, sf_dir))
