"""The log shapes this package works on, expressed over the driver's test tables.

The SQL texts are portable: the same text runs in Spark and in the checking
engine, so both start from identical rows.  Only integer arithmetic, casts and
`concat` are used, and no concatenated value is NULL (the engines disagree on
that).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import shared_dir, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def run_view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A portable view text evaluated by Spark over the named tables."""
    frames = {t: table(spark, sf_dir, t) for t in tables}
    return spark.sql(_bind(sql, tables), **frames)


def _bind(sql: str, tables: tuple[str, ...]) -> str:
    """Braces of JSON literals are escaped, table names become frame references."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f" {t} ", f" {{{t}}} ")
    return text


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Path of a table derived from the test data, written at its first use in an application.

    Queries then start from a stored table, as they do on real logs, and not
    from the expression that made it up.
    """
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _WRITTEN:
        path = shared_dir(spark, label)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def stored(spark: SparkSession, sf_dir: str, label: str, make: Callable[[], DataFrame], deal: bool = True) -> DataFrame:
    """A derived table, spread over enough files to be read in parallel.

    With `deal` its rows are dealt to that many files; rows that come spread already (a join's, or those of
    another stored table) need not be sorted and shuffled for it.
    """
    files = spark.sparkContext.defaultParallelism

    def write(path: str) -> None:
        rows = make()
        (rows.repartition(files) if deal else rows).write.parquet(path)

    return spark.read.parquet(written_once(spark, sf_dir, label, write))


def stored_view(spark: SparkSession, sf_dir: str, label: str, sql: str, name: str) -> DataFrame:
    """A stored view of one table.  The table's short rows are dealt out, not the long texts made of them."""

    def make() -> DataFrame:
        rows = table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)
        return spark.sql(_bind(sql, (name,)), **{name: rows})

    return stored(use_utc(spark), sf_dir, label, make, deal=False)


# Raw log lines, one per event: even events are requests, odd events answer the
# request before.  Some events are system prompt records instead, so that some
# requests are never answered (most of one day's) and some responses have no
# request; a few request ids are used twice.
LOG_LINES = """
SELECT ts, day, type, request_id, origin,
  concat(day, '/', hh, '-00-00-host', cast(shard AS varchar(20)), '-7-0001.jsonl') AS path,
  concat('{"timestamp":"', replace(t, ' ', 'T'), 'Z","type":"', type, '","request_id":"', request_id,
    '","session_id":', sid, ',"client":', client, ',"provider":"', provider, '","model":"', model,
    '","origin":"', origin, '"',
    CASE WHEN type = 'request' THEN
      concat(',"message_count":', cast(mc AS varchar(20)), ',"tools_count":', cast(mc % 5 AS varchar(20)),
        ',"enable_thinking":', thinking, ',"user_question":"', question, '","user_message_this_turn":"', message,
        '","tool_results_this_turn":', results, '}')
    WHEN err <> '' THEN
      concat(',"latency_ms":', cast(lat AS varchar(20)), ',"error":"', err, '"', headers, '}')
    ELSE
      concat(',"latency_ms":', cast(lat AS varchar(20)), ',"has_content":', CASE WHEN content = '' THEN 'false' ELSE 'true' END,
        ',"has_tool_calls":', CASE WHEN calls = '' THEN 'false' ELSE 'true' END, ',"content":"', content,
        '","reasoning_content":"', reasoning, '"', calls, repaired,
        ',"tokens":{"prompt_tokens":', cast(pt AS varchar(20)), ',"completion_tokens":', cast(ct AS varchar(20)),
        ',"total_tokens":', cast(pt + ct AS varchar(20)), ',"prompt_tokens_details":{"cached_tokens":', cast(pt % 100 AS varchar(20)),
        '},"cost":', cost, '}}')
    END) AS entry
FROM (
  SELECT ts, cast(ts AS varchar(30)) AS t,
    substr(cast(ts AS varchar(30)), 1, 10) AS day, substr(cast(ts AS varchar(30)), 12, 2) AS hh, user_id % 4 AS shard,
    CASE WHEN event_id % 2 = 1 AND event_id % 17 = 1 THEN 'system_prompt' WHEN event_id % 2 = 0 AND event_id % 26 = 0 THEN 'system_prompt'
      WHEN event_id % 2 = 1 AND event_id % 10 <> 9 AND cast(ts AS varchar(30)) LIKE '2024-01-15%' THEN 'system_prompt'
      WHEN event_id % 2 = 0 THEN 'request' ELSE 'response' END AS type,
    concat('r', cast(CASE WHEN event_id % 500 = 499 THEN event_id - 3 ELSE event_id - event_id % 2 END AS varchar(20))) AS request_id,
    CASE WHEN user_id % 10 = 0 THEN 'null' ELSE concat('"s', cast(user_id AS varchar(20)), '"') END AS sid,
    CASE WHEN user_id % 6 = 0 THEN 'null' ELSE concat('"app/v', cast(user_id % 3 AS varchar(20)), '"') END AS client,
    concat('https://app', cast(user_id % 4 AS varchar(20)), '.example.org',
      CASE WHEN user_id % 3 = 0 THEN concat('/agent_runner_t', cast(user_id % 2 AS varchar(20))) ELSE '' END) AS origin,
    CASE WHEN user_id % 2 = 0 THEN 'campus' ELSE 'vendor' END AS provider,
    event_type AS model, concat('q', cast(user_id % 7 AS varchar(20))) AS question,
    concat('m', cast(event_id % 97 AS varchar(20))) AS message,
    event_id % 12 AS mc,
    CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' ELSE 'null' END AS thinking,
    CASE WHEN event_id % 8 = 0 THEN concat('[{"tool_call_id":"c', cast(event_id AS varchar(20)), '","content":"row"}]') ELSE 'null' END AS results,
    cast(floor(value * 1000) AS bigint) AS lat,
    CASE WHEN event_type <> 'error' THEN ''
      WHEN value < 10 THEN 'Request timed out after 600001ms'
      WHEN value < 20 THEN 'Provider returned 402: Org member budget limit exceeded'
      WHEN value < 25 THEN 'Provider returned 500: '
      WHEN value < 30 THEN 'Client disconnected/cancelled after 30000ms (upstream still pending)'
      WHEN value < 35 THEN 'CAMPUS API key not configured on server'
      WHEN value < 40 THEN 'Unknown model x. This deployment serves: a'
      WHEN value < 45 THEN 'Streaming is not supported here'
      WHEN value < 50 THEN 'ConnectError: all attempts failed'
      WHEN value < 60 THEN 'Your credit balance is too low'
      ELSE 'Provider returned 429: slow down' END AS err,
    CASE WHEN value >= 60 THEN ',"upstream_headers":{"retry-after":"30","server":"edge","x-private":"no"}' ELSE '' END AS headers,
    CASE WHEN event_type = 'view' THEN '' ELSE concat('answer ', cast(event_id AS varchar(20))) END AS content,
    CASE WHEN event_id % 5 = 0 THEN concat('because ', cast(event_id AS varchar(20))) ELSE '' END AS reasoning,
    event_id % 500 AS pt, event_id % 90 AS ct,
    CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '0.25' END AS cost,
    CASE WHEN event_type = 'click' THEN ',"tool_calls":[{"name":"query","arguments":"{}"},{"name":"get_schema","arguments":"{}"}]'
      WHEN event_type = 'signup' THEN ',"tool_calls":[{"name":"get_stac_details","arguments":"{}"}]' ELSE '' END AS calls,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat(',"tool_call_dialect_repaired":', cast(1 + event_id % 2 AS varchar(20))) ELSE '' END AS repaired
  FROM events 
) b
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, day, type, request_id, origin, path, entry) of every log line."""
    return stored_view(spark, sf_dir, "log-lines", LOG_LINES, "events")


def legacy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five columns of a consolidated table that predates the wide schema."""
    return log_lines(spark, sf_dir).select("ts", "type", "request_id", "origin", "entry")


# An exchange: an assistant turn with all messages before it.  Every turn meets
# the earlier ones of its conversation in an equi-join; what an exchange sends is
# one array.  Some turns are re-labelled as tool results.
EXCHANGE_ROLES = """
SELECT conv_id, turn, text,
  CASE WHEN role = 'user' AND turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'tool'
       WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN 'tool' ELSE role END AS role,
  role AS said_by
FROM conversations 
"""


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(use_utc(spark), sf_dir, "exchanges", lambda: make_exchanges(spark, sf_dir))


def make_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request and response body per assistant turn.

    request_id, ts, model, messages (array of role/content/tool_call_id),
    headers (map) and body (JSON text of the upstream answer).
    """
    said = run_view(spark, sf_dir, EXCHANGE_ROLES, "conversations")
    asked = said.where(F.col("said_by") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    call = F.when(F.col("role") == "tool", F.concat(F.lit("call"), F.col("turn").cast("string")))
    earlier = said.select(
        F.col("conv_id").alias("in_conv"), F.col("turn").alias("at"),
        F.struct(F.col("role"), F.col("text").alias("content"), call.alias("tool_call_id")).alias("message"),
    )
    sent = (
        asked.join(earlier, (F.col("conv_id") == F.col("in_conv")) & (F.col("at") < F.col("turn")), "left")
        .groupBy("conv_id", "turn", "answer")
        .agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "message")))).alias("sent"))
    )
    out = sent.select("conv_id", "turn", "answer", F.transform("sent", lambda m: m["message"]).alias("messages"))
    out = out.withColumn("x1", F.try_element_at("messages", F.lit(-1))["content"])
    n = F.col("conv_id") + F.col("turn")
    reasoning = F.when(n % 4 == 0, F.col("x1"))
    alternative = F.when(n % 4 == 1, F.col("x1")).when(n % 4 == 2, F.lit(""))
    calls = F.when(
        n % 2 == 0,
        F.array(
            F.struct(
                F.struct(
                    F.lit("query").alias("name"),
                    F.concat(
                        F.lit('{"n": '), n.cast("string"), F.lit(', "s3_secret": "hush'), n.cast("string"), F.lit('"}')
                    ).alias("arguments"),
                ).alias("function")
            )
        ),
    )
    reply = F.struct(
        F.when(n % 7 != 0, F.col("answer")).alias("content"),
        reasoning.alias("reasoning_content"),
        alternative.alias("reasoning"),
        calls.alias("tool_calls"),
    )
    usage = F.struct(F.length("answer").alias("completion_tokens"))
    body = F.to_json(
        F.when(n % 11 != 0, F.struct(F.array(F.struct(reply.alias("message"))).alias("choices"), usage.alias("usage")))
        .otherwise(F.struct(F.array().cast("array<struct<message: struct<content: string, reasoning_content: string, reasoning: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>>").alias("choices"), usage.alias("usage")))
    )
    failed = n % 13 == 0
    return out.select(
        F.concat(F.lit("x"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
        "messages",
        F.when(failed, F.lit("Provider returned 503: busy")).alias("error"),
        F.when(
            failed & (F.col("conv_id") % 2 == 0),
            F.create_map(
                F.lit("Retry-After"), F.col("turn").cast("string"),
                F.lit("server"), F.lit("edge"), F.lit("x-private"), F.lit("leak"),
            ),
        ).when(failed, F.create_map(F.lit("x-private"), F.lit("leak"))).alias("headers"),
        body.alias("body"),
    )


# Tool-call arguments in the states the repair has to tell apart, with the
# expected text beside them.  `~` stands for a backslash, which the engines'
# string literals treat differently.
TOOL_ARGS = """
SELECT event_id, event_type AS model,
  CASE WHEN event_id % 5 = 0 THEN concat('{"k": ', n, ', "name": "', event_type, '"}')
       WHEN event_id % 5 = 1 THEN replace(concat('{"k": ', n, ', "v": "<arg_key>v</arg_key> <arg_value>{~"x~": ', n, '}</arg_value>"}'), '~', chr(92))
       WHEN event_id % 5 = 2 THEN concat('<arg_key>name</arg_key> <arg_value>', event_type, '</arg_value> <arg_key>k</arg_key> <arg_value>', n, '</arg_value>')
       WHEN event_id % 5 = 3 THEN concat('{"v": "<arg_value>', event_type, ' ', n, '"}')
       ELSE concat('<parameter=sql>SELECT ', n, ' FROM t</parameter>') END AS arguments,
  CASE WHEN event_id % 5 = 0 THEN concat('{"k": ', n, ', "name": "', event_type, '"}')
       WHEN event_id % 5 = 1 THEN concat('{"k": ', n, ', "v": {"x": ', n, '}}')
       WHEN event_id % 5 = 2 THEN concat('{"name": "', event_type, '", "k": ', n, '}')
       WHEN event_id % 5 = 3 THEN concat('{"v": "', event_type, ' ', n, '"}')
       ELSE concat('{"sql": "SELECT ', n, ' FROM t"}') END AS expected
FROM (SELECT event_id, event_type, cast(event_id AS varchar(20)) AS n FROM events ) e
"""

def tool_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_view(spark, sf_dir, "tool-args", TOOL_ARGS, "events")


# Log records with credentials in every place the structural scrub looks at.
SECRET_RECORDS = """
SELECT event_id, event_type AS source,
  CASE WHEN event_id % 4 = 0 THEN concat('{"id": ', n, ', "note": "nothing here"}')
       WHEN event_id % 4 = 1 THEN concat('{"id": ', n, ', "api_key": "k', n, '", "list": [{"s3_key": "a', n, '", "token": 5}]}')
       WHEN event_id % 4 = 2 THEN replace(concat('{"calls": [{"name": "query", "arguments": "{~"s3_secret~": ~"z z', n, '~", ~"n~": ', n, '}"}]}'), '~', chr(92))
       ELSE concat('{"id": ', n, ', "text": "Authorization: Bearer b', n, ' and KEY_ID ''AK', n, '''"}') END AS entry,
  CASE WHEN event_id % 4 = 0 THEN concat('{"id": ', n, ', "note": "nothing here"}')
       WHEN event_id % 4 = 1 THEN concat('{"id": ', n, ', "api_key": "[REDACTED]", "list": [{"s3_key": "[REDACTED]", "token": 5}]}')
       WHEN event_id % 4 = 2 THEN replace(concat('{"calls": [{"name": "query", "arguments": "{~"s3_secret~": ~"[REDACTED]~", ~"n~": ', n, '}"}]}'), '~', chr(92))
       ELSE concat('{"id": ', n, ', "text": "Authorization: Bearer [REDACTED] and KEY_ID ''[REDACTED]''"}') END AS expected
FROM (SELECT event_id, event_type, cast(event_id AS varchar(20)) AS n FROM events ) e
"""

def secret_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_view(spark, sf_dir, "secret-records", SECRET_RECORDS, "events")


# Object listing of a bucket: raw chunks per hour, tier files for some days, and
# names that are not days.  `side` tells the source from the mirror.
OBJECTS = """
SELECT side, path, length, mtime, tag FROM (
  SELECT 'source' AS side, concat(day, '/', hh, '-00-00-host-7-0001.jsonl') AS path, n AS length, last AS mtime, '' AS tag, d, 'raw' AS tier FROM h 
  UNION ALL SELECT 'source', concat('consolidated/daily/', day, '.parquet'), n * 3, last, '', d, 'consolidated' FROM g WHERE d % 2 = 0 OR d % 3 = 0
  UNION ALL SELECT 'source', concat('sessions/daily/', day, '.parquet'), n * 2, last, '', d, 'sessions' FROM g WHERE d % 2 = 0
  UNION ALL SELECT 'source', concat('session-rollup/daily/', day, '.parquet'), n, last, '', d, 'rollup' FROM g WHERE d % 4 = 0
  UNION ALL SELECT 'source', concat('notes/', day, '.txt'), n, last, '', d, 'other' FROM g 
  UNION ALL SELECT 'mirror', concat(day, '/', hh, '-00-00-host-7-0001.jsonl'), n, last, last, d, 'raw' FROM h WHERE d % 5 <> 0
  UNION ALL SELECT 'mirror', concat('consolidated/daily/', day, '.parquet'), n * 3, last, last, d, 'consolidated' FROM g WHERE d % 2 = 0
  UNION ALL SELECT 'mirror', concat('sessions/daily/', day, '.parquet'), CASE WHEN d % 10 = 0 THEN n ELSE n * 2 END, last,
    CASE WHEN d % 6 = 0 THEN 'old' ELSE last END, d, 'sessions' FROM g WHERE d % 6 = 0 OR d % 10 = 0
) o
"""
OBJECT_PARTS = """
h AS (SELECT substr(t, 1, 10) AS day, substr(t, 12, 2) AS hh, cast(substr(t, 9, 2) AS int) AS d, count(*) AS n, max(t) AS last
      FROM (SELECT cast(ts AS varchar(30)) AS t FROM events ) e GROUP BY 1, 2, 3),
g AS (SELECT day, d, sum(n) AS n, max(last) AS last FROM h GROUP BY 1, 2)
"""
LISTING_TODAY = "2024-01-30"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        return run_view(spark, sf_dir, f"WITH {OBJECT_PARTS} {OBJECTS}", "events").withColumn(
            "length", F.col("length").cast("bigint")
        )

    return stored(use_utc(spark), sf_dir, "objects", make)


# Job log text with provenance lines, each written twice; some keys unresolved.
VERSION_LINES = """
SELECT job, line FROM (
  SELECT concat('job', cast(c_custkey AS varchar(20))) AS job, concat('##BENCH-VERSIONS## {"agent":"',
    CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE concat('a', cast(c_custkey % 50 AS varchar(20))) END, '","app_sha":"',
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('b', cast(c_custkey AS varchar(20))) END, '","proxy_sha":"c1"}') AS line FROM customer 
  UNION ALL SELECT concat('job', cast(c_custkey AS varchar(20))), concat('##BENCH-VERSIONS## {"agent":"',
    CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE concat('a', cast(c_custkey % 50 AS varchar(20))) END, '","app_sha":"',
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('b', cast(c_custkey AS varchar(20))) END, '","proxy_sha":"c1"}') FROM customer 
  UNION ALL SELECT concat('job', cast(c_custkey AS varchar(20))), concat('starting ', c_name) FROM customer 
) v
"""

# Model ids: exact ids, vendor prefixes, and ids nobody claims.
MODEL_IDS = """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN lower(p_type)
  WHEN p_size % 5 = 1 THEN concat('acme/', lower(p_brand))
  WHEN p_size % 5 = 2 THEN concat('claude-', lower(p_type), '-', cast(p_size AS varchar(20)))
  WHEN p_size % 5 = 3 THEN concat('acme/deep/', lower(p_type), cast(p_size AS varchar(20)))
  ELSE concat('local', cast(p_size AS varchar(20))) END AS model
FROM part 
"""

# Benchmark trials: one row per event.
TRIALS = """
SELECT event_id AS trial_id, concat('app', cast(user_id % 7 AS varchar(20))) AS app,
  concat('q', cast(event_id % 5 + 1 AS varchar(20))) AS question, event_type AS model,
  value AS elapsed_s, cast(event_id % 9 AS double) AS tool_calls,
  CASE WHEN event_id % 23 = 0 THEN 'True' ELSE 'False' END AS timed_out,
  CASE WHEN value < 4 THEN 'request timed out' WHEN value < 6 THEN 'Provider returned 502' WHEN value < 8 THEN 'boom' ELSE '' END AS error,
  CASE WHEN event_id % 4 = 0 THEN 1.0 WHEN event_id % 4 = 1 THEN 0.5 WHEN event_id % 4 = 2 THEN 0.0 ELSE NULL END AS score
FROM events 
"""

# Counters: totals per (model, metric) that grow over the day and restart at
# midnight.  Weight per second of the day and metric:
METRIC_WEIGHTS = {
    "request_prefill_time_seconds_sum": 60,
    "request_prefill_time_seconds_count": 1,
    "request_decode_time_seconds_sum": 180,
    "request_decode_time_seconds_count": 1,
    "prompt_tokens_total": 3000,
    "generation_tokens_total": 700,
    "prefix_cache_hits_total": 120,
    "prefix_cache_queries_total": 300,
}
COUNTER_TICKS = """
SELECT event_type AS model, ts, (length(event_type) % 3 + 1) * (cast(substr(t, 12, 2) AS int) * 3600
  + cast(substr(t, 15, 2) AS int) * 60 + cast(substr(t, 18, 2) AS int)) AS secs
FROM (SELECT event_type, ts, cast(ts AS varchar(30)) AS t FROM events ) e
"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(use_utc(spark), sf_dir, "counters", lambda: make_counters(spark, sf_dir))


def make_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, metric, ts, value); one model reports no decode metrics."""
    weights = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("w")) for m, w in METRIC_WEIGHTS.items()])
    ticks = run_view(spark, sf_dir, COUNTER_TICKS, "events")
    return (
        ticks.select("model", "ts", "secs", F.inline(weights))
        .where(~((F.col("model") == "view") & F.col("metric").contains("decode")))
        .select("model", "metric", "ts", (F.floor(F.col("secs") * F.col("w") / 60)).cast("double").alias("value"))
    )


# Single generations with their timing; zeros and gaps included.
CALLS = """
SELECT event_id AS call_id, event_type AS model, event_id % 6 * 500 AS target_size,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(floor(value * 10) AS bigint) END AS latency_ms,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 900 END AS generation_ms,
  event_id % 500 AS prompt_tokens, event_id % 300 AS completion_tokens,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 200 END AS reasoning_tokens
FROM events 
"""

# Cell tables.  h0 is the coarse partition id, `cell` the fine id.
CELLS = """
SELECT l_partkey % 16 AS h0, l_partkey AS cell, l_extendedprice AS value, l_discount AS frac,
  l_returnflag AS klass, cast(substr(cast(l_shipdate AS varchar(30)), 1, 4) AS int) AS yr, l_suppkey AS fid
FROM lineitem 
"""
MASK = "SELECT p_partkey % 16 AS h0, p_partkey AS cell FROM part WHERE p_size >= 40"
MASK_EVEN = "SELECT p_partkey AS cell FROM part WHERE p_size % 2 = 0"
ZONES = """
SELECT p_partkey % 16 AS h0, p_partkey AS cell, p_brand AS zone, cast(floor(p_partkey / 16) AS bigint) AS parent, p_size AS size FROM part 
"""

