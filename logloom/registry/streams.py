"""Streaming queries, run over everything there is and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.registry.base import FLAT, LOG, ntz, query, with_ctes, written_once
from logloom.registry.capture import EXCHANGES, SAID, SYSTEM, scrub_sql
from logloom.schemas import WIDE_COLUMNS
from logloom.session import shared_dir
from logloom.streaming import streams

# Two late rows push the watermark past all real ones, so that every window and
# every unanswered request is given out; they are left out of the results.
SENTINEL = "2024-03-01T00:00:00Z"
SENTINEL_TS = "2024-03-01"


def _chunks(spark: SparkSession, sf_dir: str, sentinel: bool) -> str:
    def write(path: str) -> None:
        lines = fx.log_lines(spark, sf_dir).select(F.col("entry").alias("value"))
        lines.write.text(f"{path}/lines")
        if sentinel:
            last = spark.range(2).select(
                F.format_string(
                    '{"timestamp":"' + SENTINEL + '","type":"%s","request_id":"last"}',
                    F.when(F.col("id") == 0, "request").otherwise("response"),
                ).alias("value")
            )
            last.write.text(f"{path}/last")

    return written_once(spark, sf_dir, "stream-sentinel" if sentinel else "stream-plain", write)


def _drain(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """All output of a stream over the data that is there now."""
    target = shared_dir(spark, label)
    run = streams.append_chunks(stream, f"{target}/out", f"{target}/checkpoint")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.entry_stream(streams.raw_stream(spark, _chunks(spark, sf_dir, True)))


@query("stream_consolidate", with_ctes(LOG, FLAT, body=f"SELECT {', '.join(WIDE_COLUMNS)} FROM flat"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_dir(spark, "stream-consolidate")
    run = streams.stream_consolidate(spark, _chunks(spark, sf_dir, False), f"{target}/out", f"{target}/checkpoint")
    run.awaitTermination()
    return ntz(spark.read.parquet(f"{target}/out").select(*WIDE_COLUMNS), "ts")


@query(
    "append_chunks",
    with_ctes(LOG, body="SELECT entry FROM log_lines"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches into one table; nothing is lost or doubled."""
    raw = streams.raw_stream(spark, _chunks(spark, sf_dir, False), files_per_batch=2)
    return _drain(raw, spark, "stream-append")


@query(
    "stream_balance",
    with_ctes(
        LOG,
        """w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, count(*) FILTER (WHERE type = 'request') AS requests,
              count(*) FILTER (WHERE type = 'response') AS responses FROM log_lines WHERE type IN ('request', 'response') GROUP BY 1)""",
        body="""SELECT window_start, requests, responses, round(cast(responses AS double) / nullif(requests, 0), 3) AS ratio,
          coalesce(requests >= 20 AND cast(responses AS double) / nullif(requests, 0) < 0.5, false) AS alarm FROM w""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(streams.stream_balance(_entries(spark, sf_dir), "6 hours"), spark, "stream-balance")
    return ntz(out.where(F.col("window_start") < F.lit(SENTINEL_TS).cast("timestamp")), "window_start")


@query(
    "stream_pair",
    with_ctes(
        LOG, FLAT,
        body="""SELECT q.request_id, q.ts AS request_ts, q.session_id, q.model, r.ts AS response_ts, r.latency_ms, r.error,
          CASE WHEN r.ts IS NULL THEN 'incomplete' WHEN r.error <> '' THEN 'error' ELSE 'ok' END AS outcome
          FROM flat q LEFT JOIN flat r ON r.type = 'response' AND r.request_id = q.request_id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 20 MINUTE
          WHERE q.type = 'request'""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(streams.stream_pair(_entries(spark, sf_dir)), spark, "stream-pair")
    return ntz(out.where(F.col("request_ts") < F.lit(SENTINEL_TS).cast("timestamp")), "request_ts", "response_ts")


@query(
    "stream_prompts",
    with_ctes(
        SAID, EXCHANGES,
        f"s AS ({SYSTEM})",
        body=f"SELECT DISTINCT sha256(body) AS system_sha256, {scrub_sql('body')} AS content FROM s",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        fx.exchanges(spark, sf_dir).select(F.inline("messages")).select("role", "content").write.parquet(path)

    path = written_once(spark, sf_dir, "stream-messages", write)
    said = spark.readStream.schema("role string, content string").parquet(path)
    target = shared_dir(spark, "stream-prompts")
    streams.stream_prompts(said, f"{target}/out", f"{target}/checkpoint").awaitTermination()
    return streams.read_prompts(spark, f"{target}/out")


@query(
    "compact_prompts",
    with_ctes(
        SAID, EXCHANGES,
        f"s AS ({SYSTEM})",
        body=f"SELECT DISTINCT sha256(body) AS system_sha256, {scrub_sql('body')} AS content FROM s",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of two streams over the same messages, compacted: every prompt once."""

    def write(path: str) -> None:
        fx.exchanges(spark, sf_dir).select(F.inline("messages")).select("role", "content").write.parquet(path)

    path = written_once(spark, sf_dir, "stream-messages", write)
    target = shared_dir(spark, "compact-prompts")
    for checkpoint in ("first", "second"):
        said = spark.readStream.schema("role string, content string").option("maxFilesPerTrigger", 4).parquet(path)
        streams.stream_prompts(said, f"{target}/out", f"{target}/{checkpoint}").awaitTermination()
    streams.compact_prompts(spark, f"{target}/out")
    return streams.read_prompts(spark, f"{target}/out")
