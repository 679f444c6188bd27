"""Queries on serving counters and single-call timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.compat import rounded
from logloom import fixtures as fx
from logloom.operators import metrics
from logloom.registry.base import query, with_ctes

_METRICS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {w} AS w" for m, w in fx.METRIC_WEIGHTS.items())
_COUNTERS = (
    f"ticks AS ({fx.COUNTER_TICKS})",
    f"weights AS ({_METRICS})",
    """samples AS (SELECT model, metric, ts, cast(floor(cast(secs * w AS double) / 60) AS double) AS value FROM ticks, weights
       WHERE NOT (model = 'view' AND contains(metric, 'decode')))""",
    """steps AS (SELECT model, metric, value, lag(value) OVER (PARTITION BY model, metric ORDER BY ts, value) AS prev FROM samples)""",
    """inc AS (SELECT model, metric, sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS increase
       FROM steps GROUP BY model, metric)""",
)


@query("counter_increase", with_ctes(*_COUNTERS, body="SELECT * FROM inc"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter_increase(fx.counters(spark, sf_dir))


_WIDE = ", ".join(f"coalesce(max(increase) FILTER (WHERE metric = '{m}'), 0) AS {s}" for s, m in metrics.SERVING_METRICS.items())


@query(
    "prefill_decode",
    with_ctes(
        *_COUNTERS, f"wide AS (SELECT model, {_WIDE} FROM inc GROUP BY model)",
        """rates AS (SELECT *, coalesce(prefill_s / nullif(prefill_n, 0), 0) AS pre, coalesce(decode_s / nullif(decode_n, 0), 0) AS dec,
             coalesce(prompt_tok / nullif(prefill_s, 0), 0) AS pre_rate, coalesce(gen_tok / nullif(decode_s, 0), 0) AS dec_rate FROM wide
           WHERE prefill_n >= 1 OR decode_n >= 1)""",
        body="""SELECT model, cast(greatest(prefill_n, decode_n) AS bigint) AS requests, round(pre, 6) AS prefill_avg_s, round(dec, 6) AS decode_avg_s,
          round(coalesce(dec / nullif(pre, 0), 0), 6) AS decode_per_prefill, round(pre_rate, 6) AS prefill_tok_s, round(dec_rate, 6) AS decode_tok_s,
          round(coalesce(pre_rate / nullif(dec_rate, 0), 0), 6) AS rate_ratio, round(100 * coalesce(decode_s / nullif(prefill_s + decode_s, 0), 0), 6) AS decode_time_pct,
          round(100 * coalesce(cache_hit / nullif(cache_query, 0), 0), 6) AS cache_hit_pct FROM rates""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = metrics.prefill_decode_split(metrics.metric_table(metrics.counter_increase(fx.counters(spark, sf_dir))))
    return split.select("model", "requests", *[rounded(c, 6).alias(c) for c in split.columns[2:]])


@query(
    "key_union",
    "SELECT DISTINCT event_type AS model FROM events UNION SELECT DISTINCT lower(p_type) FROM part",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"))
    parts = fx.table(spark, sf_dir, "part").select(F.lower("p_type").alias("model"))
    return metrics.key_union(events, parts)


@query(
    "per_call_split",
    with_ctes(
        f"calls AS ({fx.CALLS})",
        body="""SELECT call_id, model, round(100.0 * nullif(generation_ms, 0) / (nullif(latency_ms, 0) + nullif(generation_ms, 0))) AS decode_time_pct,
          round(100.0 * nullif(reasoning_tokens, 0) / nullif(completion_tokens, 0)) AS reasoning_pct,
          round(nullif(completion_tokens, 0) / (nullif(generation_ms, 0) / 1000.0::double), 1) AS decode_tok_s,
          round(nullif(prompt_tokens, 0) / (nullif(latency_ms, 0) / 1000.0::double)) AS prefill_tok_s FROM calls""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_call_split(fx.run_view(spark, sf_dir, fx.CALLS, "events"))


@query(
    "prefill_by_size",
    with_ctes(
        f"calls AS ({fx.CALLS})",
        body="""SELECT target_size, count(*) AS runs, round(avg(prompt_tokens), 6) AS avg_input_tokens, round(avg(latency_ms), 6) AS avg_ms,
          round(avg(prompt_tokens / (latency_ms / 1000.0::double)), 4) AS avg_prefill_tok_s FROM calls WHERE latency_ms > 0 AND prompt_tokens > 0 GROUP BY 1""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.prefill_by_size(fx.run_view(spark, sf_dir, fx.CALLS, "events"))
    return got.select(
        "target_size", "runs", rounded("avg_input_tokens", 6).alias("avg_input_tokens"), rounded("avg_ms", 6).alias("avg_ms"),
        rounded("avg_prefill_tok_s", 4).alias("avg_prefill_tok_s"),
    )
