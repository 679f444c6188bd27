"""Operational statistics over entries, turns and sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import count_if, jstr, ratio, rounded, to_bigint
from logloom.functions.text import classify_error
from logloom.operators.ordering import exact_percentile, position, time_bucket
from logloom.schemas import TOOL_CALLS

# Fixed value: a client-side tool that is answered by calling another one.
TOOL_DELEGATES = {"get_schema": "get_stac_details"}


def in_window(df: DataFrame, start: Column, end: Column, ts: str = "ts", day: str | None = None) -> DataFrame:
    """Rows with start < ts <= end; with a day column the partitions prune too."""
    out = df.where((F.col(ts) > start) & (F.col(ts) <= end))
    if day:
        out = out.where(F.col(day).between(F.to_date(start), F.to_date(end)))
    return out


def by_origin(df: DataFrame, origin: str | None = None, tag: str | None = None) -> DataFrame:
    """One app by its origin, or one experiment by the end of the origin."""
    if origin is not None:
        df = df.where(F.col("origin") == origin)
    if tag is not None:
        df = df.where(F.col("origin").endswith(tag))
    return df


def exclude_synthetic(rollup: DataFrame) -> DataFrame:
    return rollup.where(~F.col("session_key_synthetic"))


def model_stats(rollup: DataFrame) -> DataFrame:
    """Per model: sessions, calls per question, seconds, cost and share that ended well."""
    return exclude_synthetic(rollup).groupBy("model").agg(
        F.count("*").alias("sessions"),
        rounded(F.avg("turns"), 1).alias("calls_per_question"),
        rounded(F.avg("wall_clock_s"), 1).alias("avg_seconds"),
        rounded(F.sum("cost_usd"), 2).alias("usd"),
        rounded(100.0 * count_if(F.col("status") == "ok") / F.count("*"), 1).cast("double").alias("pct_ok"),
    )


def experiment_grid(rollup: DataFrame) -> DataFrame:
    """Per run tag and model: sessions, calls, failures."""
    return rollup.where(F.col("run_tag").isNotNull()).groupBy("run_tag", "model").agg(
        F.count("*").alias("sessions"),
        rounded(F.avg("turns"), 1).alias("calls"),
        count_if(F.col("status") != "ok").alias("failures"),
    )


def slow_completions(responses: DataFrame, threshold_s: float = 300.0) -> DataFrame:
    """Good responses that took longer than a caller is likely to wait."""
    return responses.where(F.col("error").isNull() & (F.col("latency_ms") > F.lit(threshold_s * 1000)))


def balance_columns(min_requests: int = 20, floor: float = 0.5) -> list[Column]:
    """ratio and alarm from the counts of a window."""
    share = ratio(F.col("responses"), F.col("requests"))
    return [
        rounded(share, 3).alias("ratio"),
        F.coalesce((F.col("requests") >= min_requests) & (share < floor), F.lit(False)).alias("alarm"),
    ]


def count_by_type(entries: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Requests and responses per tumbling window; works on streams as well."""
    return (
        entries.where(F.col("type").isin("request", "response"))
        .groupBy(F.window("ts", width).alias("w"))
        .agg(
            count_if(F.col("type") == "request").alias("requests"),
            count_if(F.col("type") == "response").alias("responses"),
        )
        .select(F.col("w.start").alias("window_start"), "requests", "responses")
    )


def log_balance(entries: DataFrame, width: str = "60 seconds", min_requests: int = 20, floor: float = 0.5) -> DataFrame:
    """Windows with their request/response balance; idle windows are absent."""
    return count_by_type(entries, width).select("*", *balance_columns(min_requests, floor))


def failure_escalation(failures: DataFrame, fn: str = "fn") -> DataFrame:
    """Failures at which the running count of a function hits 10, 100, 1000, 2000, ..."""
    order = [F.col("ts").asc_nulls_last(), F.col("request_id").asc_nulls_last()]
    counted = position(failures, [fn], order, time_bucket(F.col("ts")), "nth")
    nth = F.col("nth")
    return counted.where(nth.isin(10, 100) | ((nth >= 1000) & (nth % 1000 == 0)))


def timeout_clusters(responses: DataFrame, band_ms: int = 1000) -> DataFrame:
    """Timed-out calls per provider and latency band."""
    return (
        responses.where(F.col("error").ilike("%timed out%"))
        .groupBy("provider", F.floor(F.col("latency_ms") / band_ms).cast("bigint").alias("band"))
        .agg(F.count("*").alias("calls"))
    )


def error_classes(responses: DataFrame) -> DataFrame:
    """Failed responses per provider and class of error."""
    return (
        responses.select("provider", classify_error(F.col("error")).alias("error_class"))
        .where(F.col("error_class").isNotNull())
        .groupBy("provider", "error_class")
        .agg(F.count("*").alias("calls"))
    )


def tool_load(calls: DataFrame, delegates: Mapping[str, str] = TOOL_DELEGATES, column: str = "tool_calls") -> DataFrame:
    """Calls per tool name, and the load after crediting delegates to their target."""
    one = F.from_json(F.col(column), TOOL_CALLS)
    names = calls.select(F.explode(F.transform(one, lambda c: c["name"])).alias("name")).where(F.col("name").isNotNull())
    per_name = names.groupBy("name").agg(F.count("*").alias("n"))
    target = F.lit(None).cast("string")
    for source, to in delegates.items():
        target = F.when(F.col("name") == source, F.lit(to)).otherwise(target)
    credited = per_name.select(
        F.inline(
            F.array(
                F.struct(F.col("name"), F.col("n").alias("direct"), F.col("n").alias("effective")),
                F.struct(target.alias("name"), F.lit(0).cast("bigint").alias("direct"), F.col("n").alias("effective")),
            )
        )
    ).where(F.col("name").isNotNull())
    return credited.groupBy("name").agg(F.sum("direct").alias("direct_calls"), F.sum("effective").alias("effective_calls"))


def dialect_leak_rate(responses: DataFrame) -> DataFrame:
    """Per model: responses, responses with repaired arguments, arguments repaired, rate."""
    repaired = F.coalesce(to_bigint(jstr("entry", "$.tool_call_dialect_repaired")), F.lit(0))
    return (
        responses.select("model", repaired.alias("n"))
        .groupBy("model")
        .agg(
            F.count("*").alias("responses"),
            count_if(F.col("n") > 0).alias("repaired_responses"),
            F.sum("n").alias("repaired_args"),
        )
        .withColumn("leak_rate", rounded(ratio(F.col("repaired_responses"), F.col("responses")), 6))
    )


def thinking_matrix(turns: DataFrame) -> DataFrame:
    """Requested thinking against observed reasoning per model, with median latency."""
    t = turns.where(F.col("response_ts").isNotNull()).select(
        "model",
        F.coalesce(F.col("enable_thinking").cast("string"), F.lit("unset")).alias("requested"),
        "reasoning_content", "latency_ms",
    )
    keys = ["model", "requested"]
    counts = t.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        count_if(F.coalesce(F.col("reasoning_content") != "", F.lit(False))).alias("with_reasoning"),
    )
    return counts.join(exact_percentile(t, keys, "latency_ms", 0.5, "median_latency_ms"), keys, "left")


def reasoning_effect(matrix: DataFrame) -> DataFrame:
    """Thinking on against off, per model, side by side."""
    side = lambda flag, c: F.max(F.when(F.col("requested") == flag, F.col(c)))
    return matrix.groupBy("model").agg(
        side("true", "median_latency_ms").alias("median_on_ms"),
        side("false", "median_latency_ms").alias("median_off_ms"),
    )
