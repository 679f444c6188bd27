"""Serving metrics: counter increases and where the model time goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.compat import rounded


# The serving counters, by the short name used in the formulas.
SERVING_METRICS = {
    "prefill_s": "request_prefill_time_seconds_sum",
    "prefill_n": "request_prefill_time_seconds_count",
    "decode_s": "request_decode_time_seconds_sum",
    "decode_n": "request_decode_time_seconds_count",
    "prompt_tok": "prompt_tokens_total",
    "gen_tok": "generation_tokens_total",
    "cache_hit": "prefix_cache_hits_total",
    "cache_query": "prefix_cache_queries_total",
}


def _growth(now: Column, before: Column) -> Column:
    """Growth of a counter between two samples; a fall means it restarted at 0."""
    return F.when(before.isNull(), F.lit(0.0)).when(now < before, now).otherwise(now - before)


def counter_increase(samples: DataFrame, bucket: str = "hour") -> DataFrame:
    """Growth of every (model, metric) counter over its samples, restarts included.

    No extrapolation to the window edges.  One series may hold much of the
    data, so growth is summed inside time buckets of a series, and the steps
    between buckets are added from one (first, last) pair per bucket.
    """
    series = ["model", "metric"]
    cut = samples.withColumn("b", F.date_trunc(bucket, F.col("ts").cast("timestamp")))
    at = F.struct("ts", "value")
    inside = Window.partitionBy(*series, "b").orderBy("ts", "value")
    steps = cut.withColumn("step", _growth(F.col("value"), F.lag("value").over(inside)))
    per_bucket = steps.groupBy(*series, "b").agg(
        F.sum("step").alias("inner"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    # One row per series and bucket from here on.
    between = Window.partitionBy(*series).orderBy("b")
    joined = per_bucket.withColumn("edge", _growth(F.col("first.value"), F.lag("last.value").over(between)))
    return joined.groupBy(*series).agg(F.sum(F.col("inner") + F.col("edge")).alias("increase"))


def metric_table(increases: DataFrame) -> DataFrame:
    """One row per model, one column per counter; models of any counter are kept, gaps are 0."""
    wide = increases.groupBy("model").pivot("metric", list(SERVING_METRICS.values())).agg(F.sum("increase"))
    return wide.select("model", *[F.coalesce(m, F.lit(0.0)).alias(s) for s, m in SERVING_METRICS.items()])


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prefill_decode_split(table: DataFrame) -> DataFrame:
    """Per model: seconds per request in each phase, token rates, decode share, cache hits.

    Only models with prefill or decode time that served at least one request;
    every quotient with a zero divisor is 0.
    """
    c = F.col
    known = table.where((c("prefill_s") > 0) | (c("decode_s") > 0)).where((c("prefill_n") >= 1) | (c("decode_n") >= 1))
    pre, dec = _over(c("prefill_s"), c("prefill_n")), _over(c("decode_s"), c("decode_n"))
    pre_rate, dec_rate = _over(c("prompt_tok"), c("prefill_s")), _over(c("gen_tok"), c("decode_s"))
    return known.select(
        "model",
        F.greatest("prefill_n", "decode_n").cast("bigint").alias("requests"),
        pre.alias("prefill_avg_s"),
        dec.alias("decode_avg_s"),
        _over(dec, pre).alias("decode_per_prefill"),
        pre_rate.alias("prefill_tok_s"),
        dec_rate.alias("decode_tok_s"),
        _over(pre_rate, dec_rate).alias("rate_ratio"),
        (100.0 * _over(c("decode_s"), c("prefill_s") + c("decode_s"))).alias("decode_time_pct"),
        (100.0 * _over(c("cache_hit"), c("cache_query"))).alias("cache_hit_pct"),
    )


def key_union(*vectors: DataFrame, key: str = "model") -> DataFrame:
    """All keys that occur in any of the vectors."""
    keys = [v.select(key) for v in vectors]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


def per_call_split(calls: DataFrame) -> DataFrame:
    """Per generation: decode and reasoning share and token rates; NULL on a zero or missing input."""
    def known(name: str) -> Column:
        return F.nullif(F.col(name).cast("double"), F.lit(0.0))

    lat, gen = known("latency_ms"), known("generation_ms")
    prompt, done, thought = known("prompt_tokens"), known("completion_tokens"), known("reasoning_tokens")
    return calls.select(
        "call_id", "model",
        rounded(100.0 * gen / (lat + gen)).alias("decode_time_pct"),
        rounded(100.0 * thought / done).alias("reasoning_pct"),
        rounded(done / (gen / 1000.0), 1).alias("decode_tok_s"),
        rounded(prompt / (lat / 1000.0)).alias("prefill_tok_s"),
    )


def prefill_by_size(calls: DataFrame) -> DataFrame:
    """Per prompt size: runs, mean input tokens, mean ms and mean prefill rate, over runs with a rate."""
    rate = F.when(F.col("latency_ms") > 0, F.col("prompt_tokens") / (F.col("latency_ms") / 1000.0))
    rated = calls.withColumn("rate", rate).where(F.coalesce(F.col("rate"), F.lit(0.0)) > 0)
    return rated.groupBy("target_size").agg(
        F.count("*").alias("runs"),
        F.avg("prompt_tokens").alias("avg_input_tokens"),
        F.avg("latency_ms").alias("avg_ms"),
        F.avg("rate").alias("avg_prefill_tok_s"),
    )


