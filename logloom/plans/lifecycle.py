"""What the tiers still need, judged from object listings.

Every function returns keys; none copies or deletes anything.  A listing is a
frame with `path`, relative to the lake's root (`relative_to` makes it so); days are set-compared as joins, so a listing of any size is
handled like other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RAW = r"^(?:log_day=)?(\d{4}-\d{2}-\d{2})/"


def raw_objects(listing: DataFrame) -> DataFrame:
    """Raw chunks with their day; names that do not start with a date are ignored."""
    day = F.regexp_extract("path", _RAW, 1)
    return listing.withColumn("day", F.when(F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").isNotNull(), day)).where(
        F.col("day").isNotNull()
    )


def raw_days(listing: DataFrame) -> DataFrame:
    return raw_objects(listing).select("day").distinct()


def relative_to(listing: DataFrame, root: str) -> DataFrame:
    """`path` below the root, whatever scheme and authority the listing names."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
    prefix = F.concat(F.rtrim(bare(F.lit(root)), F.lit("/")), F.lit("/"))
    path = bare(F.col("path"))
    return listing.where(F.startswith(path, prefix)).withColumn("path", F.substring(path, F.length(prefix) + 1, F.length(path)))


def tier_periods(listing: DataFrame, tier: str, grain: str = "daily") -> DataFrame:
    """Periods a tier has a file for: `<tier>/<grain>/log_date=<day>/<file>`, as `write_tier`
    lays them out, or one file `<tier>/<grain>/<period>.parquet`.
    """
    name = F.regexp_extract("path", rf"^{tier}/{grain}/log_date=(\d{{4}}-\d{{2}}-\d{{2}})/[^/]+\.parquet$", 1)
    single = F.regexp_extract("path", rf"^{tier}/{grain}/(?:[^=]*/)?([^/=]+)\.parquet$", 1)
    day = F.left(name, F.lit(7)) if grain == "monthly" else name
    period = F.coalesce(F.nullif(day, F.lit("")), F.nullif(single, F.lit("")))
    return listing.select(period.alias("day")).where(F.col("day").isNotNull()).distinct()


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "day", "left_anti")


def plan_consolidation(listing: DataFrame, today: str) -> DataFrame:
    """Raw days without a consolidated file, today left out."""
    return _minus(raw_days(listing).where(F.col("day") != today), tier_periods(listing, "consolidated"))


def plan_backfill(listing: DataFrame, today: str, grain: str = "daily") -> DataFrame:
    """(action, day) for periods that have one tier but lack the next.

    Days queued for consolidation get all their tiers in that pass.
    """
    base, turns, rollups = (tier_periods(listing, t, grain) for t in ("consolidated", "sessions", "session-rollup"))
    need_turns, need_rollup = _minus(base, turns), _minus(turns, rollups)
    if grain == "daily":
        queued = plan_consolidation(listing, today)
        need_turns, need_rollup = _minus(need_turns, queued), _minus(need_rollup, queued)
    return need_turns.select(F.lit("build_turns").alias("action"), "day").unionByName(
        need_rollup.select(F.lit("build_rollup").alias("action"), "day")
    )


def plan_sweep(listing: DataFrame, today: str) -> DataFrame:
    """Raw objects that may go: their day has both a consolidated and a turn file, and is not today."""
    done = tier_periods(listing, "consolidated").join(tier_periods(listing, "sessions"), "day", "left_semi")
    return raw_objects(listing).where(F.col("day") != today).join(done, "day", "left_semi").select("day", "path")


def plan_prune(mirror: DataFrame, today: str) -> DataFrame:
    """The same on a mirror, judged by the mirror's own tiers and never by the source's."""
    return plan_sweep(mirror, today)


def plan_superseded(listing: DataFrame) -> DataFrame:
    """(tier, day) of daily files whose month has a monthly file of the same tier."""
    def side(tier: str) -> DataFrame:
        days = tier_periods(listing, tier).withColumn("month", F.left("day", F.lit(7)))
        months = tier_periods(listing, tier, "monthly").select(F.col("day").alias("month"))
        return days.join(months, "month", "left_semi").select(F.lit(tier).alias("tier"), "day")

    return side("consolidated").unionByName(side("sessions")).unionByName(side("session-rollup"))


def mirror_diff(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """Objects to copy: missing in the mirror, or with another size or another source-time tag.

    Source columns: path, length, mtime; mirror columns: path, length, tag.
    """
    there = mirror.select("path", F.col("length").alias("__len"), F.col("tag").alias("__tag"), F.lit(True).alias("__there"))
    joined = source.select("path", "length", "mtime").join(there, "path", "left")
    current = F.col("__tag").eqNullSafe(F.col("mtime")) & F.col("__len").eqNullSafe(F.col("length"))
    return joined.where(F.col("__there").isNull() | ~current).select(
        "path", "length", F.when(F.col("__there").isNull(), "missing").otherwise("changed").alias("reason")
    )


def counts_match(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Row counts per group of a table and its rewrite; `ok` must hold before a swap."""
    a = before.groupBy(by).agg(F.count("*").alias("rows_before"))
    b = after.groupBy(by).agg(F.count("*").alias("rows_after"))
    return a.join(b, by, "full_outer").select(
        by, "rows_before", "rows_after", F.col("rows_before").eqNullSafe(F.col("rows_after")).alias("ok")
    )
