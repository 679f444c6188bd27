"""Scrub reports, repair of tool arguments, provenance and pairing checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import count_if
from logloom.functions.dialect import repair_tool_args
from logloom.functions.scrub import scrub_json, scrub_text

Scrubber = Callable[[Column], Column]


def scrub_column(df: DataFrame, column: str, how: Scrubber = scrub_text) -> DataFrame:
    return df.withColumn(column, how(F.col(column)))


def residual_secrets(df: DataFrame, column: str, by: Sequence[str], how: Scrubber = scrub_text) -> DataFrame:
    """Rows another scrub would still change, per group; empty for a clean table.

    The test is the fixed point, not a search for key names: a redaction marker
    sits beside the same names.
    """
    counts = _changes(df, column, by, how).groupBy(*by).agg(count_if(F.col("changed")).alias("residual_rows"))
    return counts.where(F.col("residual_rows") > 0)


def _changes(df: DataFrame, column: str, by: Sequence[str], how: Scrubber) -> DataFrame:
    """Whether a scrub changes the row, computed once per row and counted, never filtered on.

    A filter would be pushed below the scrub and make it run again.
    """
    again = df.select(*by, F.col(column).alias("__was"), how(F.col(column)).alias("__now"))
    return again.select(*by, (~F.col("__was").eqNullSafe(F.col("__now"))).alias("changed"))


def scrub_report(df: DataFrame, column: str, by: Sequence[str], how: Scrubber = scrub_json) -> DataFrame:
    """Dry run: per group, rows, rows that would change, and whether to rewrite it."""
    return (
        _changes(df, column, by, how)
        .groupBy(*by)
        .agg(F.count("*").alias("rows_scanned"), count_if(F.col("changed")).alias("rows_changed"))
        .withColumn("needs_rewrite", F.col("rows_changed") > 0)
    )


def scrub_entries(entries: DataFrame, *more: str) -> DataFrame:
    """Legacy columns (and `more`) with scrubbed entries; derived columns are rebuilt, not patched."""
    return entries.select("ts", "type", "request_id", "origin", scrub_json(F.col("entry")).alias("entry"), *more)


def repair_arguments(df: DataFrame, column: str = "arguments") -> DataFrame:
    """`column` repaired, and a `repaired` flag beside it."""
    fixed = df.withColumn("__fix", repair_tool_args(F.col(column)))
    return fixed.withColumn(column, F.col("__fix.arguments")).withColumn("repaired", F.col("__fix.repaired")).drop("__fix")


# The tag of a provenance line and the keys that must be resolved.
PROVENANCE_TAG = "##BENCH-VERSIONS## "
PROVENANCE_KEYS = ("agent", "app_sha", "proxy_sha")


def provenance_check(log_lines: DataFrame, keys: Sequence[str] = PROVENANCE_KEYS) -> DataFrame:
    """One row per job and distinct provenance line, with the keys it leaves open."""
    doc = F.regexp_extract("line", f"^{PROVENANCE_TAG}(.*)$", 1)
    found = (
        log_lines.where(F.col("line").startswith(PROVENANCE_TAG))
        .select("job", F.from_json(doc, "map<string, string>").alias("v"))
        .select("job", *[F.try_element_at("v", F.lit(k)).alias(k) for k in keys])
        .distinct()
    )
    open_keys = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(k), F.lit("")).isin("", "unknown"), F.lit(k)) for k in keys])
    )
    return found.select(
        "job", *keys,
        F.array_join(open_keys, ",").alias("unresolved"),
        (F.size(open_keys) == 0).alias("valid"),
    )


def orphan_audit(entries: DataFrame) -> DataFrame:
    """Unanswered requests, responses without request, and request ids used more than once.

    One pass: per request id the requests and responses are counted, which
    combines before the shuffle, so a much repeated id is no burden.
    """
    per_id = entries.where(F.col("type").isin("request", "response") & F.col("request_id").isNotNull()).groupBy("request_id").agg(
        count_if(F.col("type") == "request").alias("requests"), count_if(F.col("type") == "response").alias("responses")
    )
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("responses") == 0, F.col("requests"))), F.lit(0)).alias("unanswered_requests"),
        F.coalesce(F.sum(F.when(F.col("requests") == 0, F.col("responses"))), F.lit(0)).alias("orphan_responses"),
        count_if((F.col("requests") > 1) | (F.col("responses") > 1)).alias("repeated_ids"),
    )
