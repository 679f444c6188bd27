"""Reading, writing and rewriting the stored tiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.ordering import time_bucket
from logloom.session import shared_dir
from logloom.sources import chunk_index
from logloom.sources.chunk_index import DAY, days_in, folder_of, one_of, remove, size_of  # noqa: F401

TIERS = ("consolidated", "sessions", "session-rollup")
REPORT_ERROR_CHARS = 100  # Fixed value: width of the error column in reports.


def tier_path(root: str, tier: str) -> str:
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS}, not {tier!r}")
    return f"{root.rstrip('/')}/{tier}"


# Folder of a tier's grain; a tier is <root>/<tier>/<grain>/log_date=<day>/<files>.
GRAINS = {"day": "daily", "month": "monthly"}


def grain_path(root: str, tier: str, scope: str) -> str:
    return f"{tier_path(root, tier)}/{GRAINS[scope]}"


def read_tier(spark: SparkSession, root: str, tier: str, grain: str = "daily") -> DataFrame:
    """One grain of a tier, with log_date, by which a filter prunes folders.

    The monthly grain holds the same turns and sessions as the daily one, so the
    two are never read together.  Other tiers are never touched.
    """
    return spark.read.parquet(f"{tier_path(root, tier)}/{grain}")


def read_mixed(spark: SparkSession, *paths: str) -> DataFrame:
    """Legacy and wide files together, matched by column name; absent columns are NULL."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A tier as `write_tier` lays it out, with log_date for pruning."""
    return spark.read.parquet(path)


# Stored bytes that one task of an ordered write takes: in memory a compressed record is about twenty times as large.
TASK_BYTES = 16 << 20
LINE_BYTES = 128 << 20  # the same for lines of text, which are not compressed


def by_range(df: DataFrame, tasks: int, *keys: Column | str) -> DataFrame:
    """Range-partitioned by the session's number of tasks, or by `tasks` if they are more."""
    many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *keys) if many else df.repartitionByRange(*keys)


def write_tier(
    df: DataFrame, path: str, ts: str = "ts", order: Sequence[str] = ("ts",), mode: str = "overwrite", day: Column | None = None,
    size: int | None = None,
) -> None:
    """zstd Parquet by log_date (the day of `ts`, or `day`), in time order.

    Rows are range-partitioned by (day, time): a day that holds much of the
    data is written by several tasks into several files, each a stretch of the
    day in order, and quiet days share a task.  Only the days present in `df`
    are replaced (`replace_days` also empties days).  The session's shuffle setting gives the number
    of tasks, unless the stored `size` of the rows asks for more.
    """
    dated = df.withColumn(DAY, F.to_date(ts) if day is None else day)
    keys = [F.col(DAY), time_bucket(F.col(ts)), *[F.col(c) for c in order]]
    (
        by_range(dated, (size or 0) // TASK_BYTES + 1, *keys).sortWithinPartitions(DAY, *order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(DAY)
        .parquet(path)
    )


def replace_days(
    df: DataFrame, path: str, owned: Iterable[date | None], ts: str, order: Sequence[str], day: Column | None = None,
    size: int | None = None,
) -> dict[date | None, int]:
    """Makes the rows of `df` all that a table holds for the days `owned`; returns rows by day.

    The rows are complete and counted, as a staged table, before anything is replaced.  Days
    that the new rows bring are overwritten; owned days that they no longer bring are removed, after
    the stored counts have been found right.  A row outside `owned` is an error, and nothing is touched.
    A `size` says that `df` is a stored table of so many bytes, which needs no staging.
    """
    spark, owned, staging = df.sparkSession, set(owned), None
    staged = df.withColumn(DAY, F.to_date(ts) if day is None else day)
    if size is None:
        staging = shared_dir(spark, "replacement")
        staged.write.parquet(staging)
        staged, size = spark.read.parquet(staging), size_of(spark, staging)
    counts = {r[0]: r[1] for r in staged.groupBy(DAY).count().collect()}  # days of the calendar
    if set(counts) - owned:
        raise ValueError(f"{path}: rows of days outside the replaced ones: {sorted(map(str, set(counts) - owned))[:3]}")
    if counts:
        write_tier(staged, path, ts, order, day=F.col(DAY), size=size)
        spark.catalog.refreshByPath(path)
        stored = spark.read.parquet(path).where(one_of(F.col(DAY), counts)).groupBy(DAY).count().collect()
        if {r[0]: r[1] for r in stored} != counts:
            raise RuntimeError(f"{path}: stored rows differ from the staged ones; no day was removed")
    for gone in (owned - set(counts)) & set(days_in(spark, path)):
        remove(spark, f"{path}/{folder_of(gone)}")
    spark.catalog.refreshByPath(path)
    if staging:
        remove(spark, staging)
    return counts


def rewrite_in_place(
    spark: SparkSession, path: str, fn: Callable[[DataFrame], DataFrame], partition: str | None = DAY,
    only: DataFrame | None = None, order: str = "ts",
) -> int:
    """Replaces a table by fn(table) by way of a staging table; returns the row count.

    The new rows are complete and counted before anything is overwritten; if the
    count differs the original is left alone.  `only`, a frame of partition values,
    limits the rewrite to those partitions (NULL is one).  The staging table is
    removed once the rows are in place.
    """
    source = spark.read.parquet(path)
    if only is not None:
        named = only.select(F.col(partition).alias("__only"))
        source = source.join(named, F.col(partition).eqNullSafe(F.col("__only")), "left_semi")
    staging = shared_dir(spark, "staging")
    writer = fn(source).write.mode("errorifexists").option("compression", "zstd")
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(staging)
    staged = spark.read.parquet(staging)
    before, after = source.count(), staged.count()
    if before != after:
        raise RuntimeError(f"{path}: {after} rows staged of {before}; original untouched")
    if partition:
        keys = [F.col(partition), F.col(order)]
        out = by_range(staged, size_of(spark, staging) // TASK_BYTES + 1, *keys).sortWithinPartitions(*keys).write.partitionBy(partition)
        out = out.option("partitionOverwriteMode", "dynamic")
    else:
        out = staged.repartitionByRange(F.col(order)).sortWithinPartitions(order).write
    out.mode("overwrite").option("compression", "zstd").parquet(path)
    spark.catalog.refreshByPath(path)
    remove(spark, staging)
    return after


def chunk_place(path: Column) -> dict[str, Column]:
    """Where a raw file belongs: id of its root, chunk day (or NULL) and name of its chunk."""
    pattern = r"^(.*?)(?:(?:log_day=)?(\d{4}-\d{2}-\d{2})/)?(?:chunk=)?([^/]+?)(?:\.jsonl/[^/]*)?$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return {
        "root": F.lower(F.hex(F.xxhash64(part(1)))), "log_day": F.nullif(part(2), F.lit("")),
        "chunk": F.concat(F.regexp_replace(part(3), r"\.jsonl$", ""), F.lit(".jsonl")),
    }


def rewrite_jsonl(spark: SparkSession, raw: DataFrame, how: Callable[[Column], Column], out: str) -> DataFrame:
    """Raw chunks with every line rewritten, written only where a line changed.

    `raw` is (entry, path, ...).  New chunks go below `out` as
    root=<id>/log_day=<day>/chunk=<name>/<parts>, which `read_raw` reads like
    the originals, day and hour included; the id tells apart chunks of the same
    name below different roots.  Lines keep the order of `position`, a column
    that `read_raw` gives.  The sources stay as they are.  Returns (path, lines,
    changed_lines).

    The first pass counts changes per chunk and stores the counts; the second
    rewrites the lines of changed chunks only, usually a small part.  A chunk of
    any size is written by several tasks, in parts that follow each other.
    """
    keys = ["root", "log_day", "chunk"]
    tested = raw.select("path", F.col("entry").alias("__was"), how(F.col("entry")).alias("__now"))
    changed = F.count_if(~F.col("__was").eqNullSafe(F.col("__now")))
    counts = shared_dir(spark, "chunk-counts")
    size = F.sum(F.octet_length("__was")).alias("__bytes")
    tested.groupBy("path").agg(F.count("*").alias("lines"), changed.alias("changed_lines"), size).write.parquet(counts)
    counted = spark.read.parquet(counts)
    report = counted.drop("__bytes")
    rewritten = counted.where("changed_lines > 0").agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0]

    # a chunk's place is worked out once, and not for every line of it
    touched = report.where(F.col("changed_lines") > 0).select("path", *[c.alias(n) for n, c in chunk_place(F.col("path")).items()])
    position = F.col("position") if "position" in raw.columns else F.lit(None).cast("long")
    (
        by_range(
            raw.withColumn("__position", position).select("path", "entry", "__position").join(touched, "path")
            .select("entry", *keys, F.col("__position").alias("position")),
            rewritten // LINE_BYTES + 1, *keys, "position",
        )
        .sortWithinPartitions(*keys, "position")
        .select(how(F.col("entry")).alias("value"), *keys)
        .write.mode("errorifexists")
        .partitionBy(*keys)
        .text(out)
    )
    return report


def report_text(df: DataFrame, error: str = "error") -> DataFrame:
    """Report frame with tabs and line breaks in the error blanked and its length cut."""
    flat = F.translate(F.coalesce(F.col(error), F.lit("")), "\t\n", "  ")
    return df.withColumn(error, F.substring(flat, 1, REPORT_ERROR_CHARS))


def write_report(df: DataFrame, path: str, error: str = "error") -> None:
    """Tab-separated report with a header line per file."""
    report_text(df, error).write.mode("overwrite").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)
