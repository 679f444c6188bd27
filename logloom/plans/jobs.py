"""The daily and monthly jobs as one chain over all pending periods.

A consolidated day is the day of the raw chunk; turns and sessions are filed by record day.  The
chunk index links the two, the manifest says what was built from what (`sources/chunk_index.py`).
Every job may be run again after a failure and then ends as if it had not failed: what it
replaces is complete before it is swapped in, and the index is written last.  One job runs at a time.
"""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.scrub import scrub_json
from logloom.operators.flatten import flatten_entries, upgrade_schema
from logloom.operators.quality import residual_secrets, scrub_entries, scrub_report
from logloom.operators.sessions import session_rollup
from logloom.operators.turns import pair_turns
from logloom.schemas import WIDE_COLUMNS
from logloom.session import shared_dir, use_utc
from logloom.sources import chunk_index as ci
from logloom.sources.raw import is_document, read_raw
from logloom.sources.tiers import DAY, GRAINS, TIERS, chunk_place, grain_path, replace_days, rewrite_in_place, rewrite_jsonl

Days = Iterable["date | None"]


def _stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _stored(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:  # nothing there, or nothing in it
        return False
    return True


def _outside(column: Column, days: Days) -> Column:
    return ~F.coalesce(ci.one_of(column, days), F.lit(False))


# ---- consolidation -----------------------------------------------------------


def consolidate(spark: SparkSession, raw: DataFrame, root: str) -> DataFrame:
    """Writes the three tiers for all chunk days in `raw`; returns the quarantined lines.

    The consolidated tier is filed by the day of the raw chunk, as the chunks
    are.  A chunk holds records of the evening before, so filing by record time
    would replace a day by the few records of it that a later chunk brings.
    `raw` must hold its chunk days whole; those days are replaced, and no other,
    also where a stream has filled them or no good line is left.  Chunks without
    a day in their name form one undated day.

    Each line is parsed once, into a staged table that the ordered write reads.
    Turns and sessions are rebuilt for the record days that the replaced chunk days held before
    or hold now, from all chunk days with records of them.
    """
    use_utc(spark)
    lines = raw if "path" in raw.columns else raw.withColumn("path", F.lit(""))
    flagged = lines.withColumnRenamed("log_day", DAY).withColumn("__good", is_document(F.col("entry")))
    parsed, staging = _stage(flatten_entries(flagged), "parsed")
    good = parsed.where("__good").select(*WIDE_COLUMNS, DAY)
    bad = parsed.where("NOT __good").withColumnRenamed(DAY, "log_day")
    bad, _ = _stage(bad.select(*[c for c in raw.columns]), "quarantine")
    fresh, _ = _stage(ci.index_rows(parsed, F.col("__good")), "index-rows")

    before = ci.read_index(spark, root)
    replaced = ci.distinct_days(fresh, DAY)
    touched = before.where(ci.one_of(F.col(DAY), replaced)).where("rows > 0").select("record_day")
    touched = ci.distinct_days(touched.unionAll(fresh.where("rows > 0").select("record_day")), "record_day")
    replace_days(good, grain_path(root, "consolidated", "day"), replaced, "ts", ("ts",), F.col(DAY), ci.size_of(spark, staging))
    now = before.where(_outside(F.col(DAY), replaced)).unionByName(fresh.withColumn("writer", F.lit(ci.BATCH_WRITER)))
    rebuild(spark, root, "day", touched, now)
    # last: until here a repeated run finds the record days that were replaced
    ci.write_index(fresh, root, ci.BATCH_WRITER)
    ci.drop_other_writers(spark, root, replaced, ci.BATCH_WRITER)
    ci.remove(spark, staging)
    return bad


# ---- turns and sessions ------------------------------------------------------


def _period(ts: Column, scope: str) -> Column:
    return F.to_date(ts) if scope == "day" else F.trunc(F.to_date(ts), "month")


def _days_of(starts: set[date | None], scope: str) -> set[date | None]:
    """Every day of the calendar that rows of these periods are filed under."""
    if scope == "day":
        return set(starts)
    return {d for s in starts for d in ([None] if s is None else [s.replace(day=i + 1) for i in range(monthrange(s.year, s.month)[1])])}


def concerned_entries(spark: SparkSession, root: str, scope: str, starts: set[date | None], index: DataFrame) -> DataFrame:
    """Consolidated entries of the periods: only the chunk days that the index names are read."""
    held = None
    if not index.isEmpty():
        held = ci.distinct_days(index.where("rows > 0").where(ci.one_of(_period(F.col("record_day"), scope), starts)), DAY)
    rows = read_history(spark, root, "consolidated", index, held).where(ci.one_of(_period(F.col("ts"), scope), starts))
    dated = sorted(_days_of(starts - {None}, scope))
    if dated and None not in starts:  # also as a range, which prunes row groups of the ordered files
        rows = rows.where((F.col("ts") >= F.lit(dated[0])) & (F.col("ts") < F.date_add(F.lit(dated[-1]), 1)))
    return upgrade_schema(rows).select(*WIDE_COLUMNS)


def rebuild(
    spark: SparkSession, root: str, scope: str = "day", periods: DataFrame | Days | None = None, index: DataFrame | None = None,
) -> None:
    """Turn and session tiers of one grain, for the given periods or for everything stored.

    `periods` are the record days concerned (a frame with column `period`, or days; None stands
    for undated records); with month scope their months are rebuilt.  Days and
    months are kept apart: with month scope the index runs across midnight and
    sessions are rebuilt from the turns, because rows of day-scoped sessions
    cannot be added up.

    A build owns every day its periods are filed under: days it no longer fills are emptied,
    so a session whose start has moved is not left where it began before.
    """
    use_utc(spark)
    index = ci.read_index(spark, root) if index is None else index
    turn_path, rollup_path = grain_path(root, "sessions", scope), grain_path(root, "session-rollup", scope)
    if periods is None:
        known = index.where("rows > 0").select("record_day")
        if index.isEmpty():
            known = read_history(spark, root, "consolidated", index).select(F.to_date("ts").alias("record_day"))
        days = [*ci.distinct_days(known, "record_day"), *ci.days_in(spark, turn_path), *ci.days_in(spark, rollup_path)]
    else:
        days = ci.distinct_days(periods, "period") if isinstance(periods, DataFrame) else list(periods)
    starts = {ci.period_start(d, scope) for d in days}
    if not starts:
        return
    owned = _days_of(starts, scope)
    turns = pair_turns(concerned_entries(spark, root, scope, starts, index), scope)
    filed = replace_days(turns, turn_path, owned, "request_ts", ("session_key", "turn_idx"))
    rollup = session_rollup(spark.read.parquet(turn_path).where(ci.one_of(F.col(DAY), filed)), scope) if filed else None
    rolled = replace_days(rollup, rollup_path, owned, "started_at", ("started_at",)) if filed else _empty(spark, rollup_path, owned)
    _note(spark, root, scope, starts, ci.records_by_period(index, scope), {"sessions": filed, "session-rollup": rolled})


def _empty(spark: SparkSession, path: str, days: Days) -> dict:
    for day in set(days) & set(ci.days_in(spark, path)):
        ci.remove(spark, f"{path}/{ci.folder_of(day)}")
    return {}


def _name(start: date | None) -> str:
    return ci.UNDATED if start is None else start.isoformat()


def _note(spark: SparkSession, root: str, scope: str, starts: set[date | None], entries: DataFrame, filed: dict[str, dict]) -> None:
    """Writes the manifest of the periods just built; a period with no rows left leaves it."""
    names = {_name(s) for s in starts}
    built_from = {r["period"]: r["entries"] for r in entries.where(F.col("period").isin(*names)).collect()}
    owned = []
    for tier, counts in filed.items():
        own = [(tier, _name(ci.period_start(d, scope)), d, n) for d, n in counts.items()]
        # a period with records but no rows (responses alone) is built as well
        own += [(tier, p, None, 0) for p in sorted(set(built_from) - {o[1] for o in own})]
        owned += [(*o, built_from.get(o[1], 0)) for o in own]
        for gone in names - {o[1] for o in own}:
            ci.remove(spark, f"{ci.manifest_path(root)}/tier={tier}/grain={GRAINS[scope]}/period={gone}")
    ci.write_manifest(spark, root, GRAINS[scope], owned)


def stale_periods(spark: SparkSession, root: str, tier: str = "sessions", scope: str = "day", index: DataFrame | None = None) -> DataFrame:
    """(period, entries, built_from) of periods whose records are not those the tier was built from."""
    by = DAY if tier == "consolidated" else "record_day"
    entries = ci.records_by_period(ci.read_index(spark, root) if index is None else index, scope, by)
    built = ci.read_manifest(spark, root, tier, GRAINS[scope]).groupBy("period").agg(F.max("entries").alias("built_from"))
    both = entries.join(built, "period", "full_outer")
    return both.where(~F.col("entries").eqNullSafe(F.col("built_from"))).select("period", "entries", "built_from")


def rebuild_pending(spark: SparkSession, root: str, scope: str = "day") -> list[str]:
    """Rebuilds the periods whose records have changed since their last build; returns their names."""
    names = sorted(r["period"] for r in stale_periods(spark, root, "sessions", scope).collect())
    if names:
        rebuild(spark, root, scope, [None if n == ci.UNDATED else date.fromisoformat(n) for n in names])
    return names


# ---- months ------------------------------------------------------------------


def compact_months(spark: SparkSession, root: str, months: Days | None = None) -> None:
    """The consolidated tier by month: the same rows in fewer files, still filed by chunk day.

    Once a month is written its days may be pruned (`plans.lifecycle.plan_superseded`); `read_history`
    then reads the month.
    """
    use_utc(spark)
    index = ci.read_index(spark, root)
    paths = [grain_path(root, "consolidated", s) for s in GRAINS]
    days = {d for p in paths for d in ci.days_in(spark, p)}
    starts = {ci.period_start(d, "month") for d in (days if months is None else months)}
    owned = {d for d in days if ci.period_start(d, "month") in starts}
    if not owned:
        return
    source = read_history(spark, root, "consolidated", index).where(ci.one_of(F.col(DAY), owned))
    filed = replace_days(source.select(*WIDE_COLUMNS, DAY), paths[1], owned, "ts", ("ts",), F.col(DAY))
    _note(spark, root, "month", starts, ci.records_by_period(index, "month", DAY), {"consolidated": filed})


def read_history(spark: SparkSession, root: str, tier: str, index: DataFrame | None = None, days: Days | None = None) -> DataFrame:
    """A tier over all time (or of some days), each row once: a month where it is complete, days elsewhere.

    A month is complete if it was built from the records that the index names now.  In any other month
    a day that is there counts, as it is newer, and the month stands in for the days that are not.
    """
    paths = {s: grain_path(root, tier, s) for s in GRAINS}
    wanted = None if days is None else set(days)
    there = {s: [d for d in ci.days_in(spark, p) if wanted is None or d in wanted] for s, p in paths.items()}
    stale = {r["period"] for r in stale_periods(spark, root, tier, "month", index).collect()} if there["month"] else set()
    built = {r["period"] for r in ci.read_manifest(spark, root, tier, GRAINS["month"]).select("period").distinct().collect()} if there["month"] else set()
    whole = lambda d: _name(ci.period_start(d, "month")) in built - stale
    chosen = {
        "day": [d for d in there["day"] if not whole(d)],
        "month": [d for d in there["month"] if whole(d) or d not in set(there["day"])],
    }
    parts = [spark.read.parquet(paths[s]).where(ci.one_of(F.col(DAY), own)) for s, own in chosen.items() if own]
    if not parts:  # the columns of whichever grain there is
        return next(spark.read.parquet(p) for p in paths.values() if ci.days_in(spark, p)).where("false")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


# ---- scrubbing what is stored ------------------------------------------------


def scrub_raw(spark: SparkSession, raw_root: str, today: str, root: str | None = None) -> DataFrame:
    """Replaces the raw chunks that hold credentials by scrubbed ones; returns (path, lines, changed_lines).

    The changed chunks are rewritten aside, counted line by line against the originals and
    scrubbed once more without effect before any of them is published, each in its own folder beside the
    original (`<day>/chunk=<name>/<parts>`, which the readers take for the chunk).  Then the originals
    go.  A run that was cut off is repeated as a whole: what it had published is replaced.  With `root`
    the new files are entered in the lake's chunk index, so that no stream takes them for new chunks.
    Publishing touches names only, one at a time, and only of changed chunks.
    """
    lines = read_raw(spark, raw_root).where(~F.col("log_day").eqNullSafe(F.to_date(F.lit(today))))
    aside = shared_dir(spark, "scrubbed-chunks")
    report = rewrite_jsonl(spark, lines, scrub_json, aside)
    changed = report.where("changed_lines > 0")
    if changed.isEmpty():
        return report
    rewritten = read_raw(spark, aside)
    wanted = changed.agg(F.sum("lines")).first()[0]
    again = scrub_report(rewritten, "entry", ["path"]).agg(F.coalesce(F.sum("rows_scanned"), F.lit(0)), F.sum("rows_changed"))
    got, unclean = again.first()  # in one reading
    if wanted != got:
        raise RuntimeError(f"{raw_root}: {got} lines rewritten of {wanted}; originals untouched")
    if unclean:
        raise RuntimeError(f"{raw_root}: rewritten chunks are not clean; originals untouched")
    _publish(spark, changed, aside, root)
    return report


def _publish(spark: SparkSession, changed: DataFrame, aside: str, root: str | None) -> None:
    placed = changed.select("path", *[c.alias(n) for n, c in chunk_place(F.col("path")).items()])
    done: set[tuple] = set()
    entered = []
    for row in placed.toLocalIterator():
        folder, name = row["path"].rsplit("/", 1)
        inside = folder.rsplit("/", 1)[-1].startswith("chunk=")
        target = folder if inside else f"{folder}/chunk={row['chunk']}"
        key = (row["root"], row["log_day"], row["chunk"])
        if key not in done:
            done.add(key)
            if not inside:  # left by a run that was cut off
                ci.remove(spark, target)
            source = f"{aside}/root={row['root']}/log_day={row['log_day'] or '__HIVE_DEFAULT_PARTITION__'}/chunk={row['chunk']}"
            parts = ci.names_in(spark, source)
            if not inside:  # the whole folder by one name
                ci.move(spark, source, target)
            for part in parts:
                if inside:
                    ci.move(spark, f"{source}/{part}", f"{target}/{part}")
                entered.append((f"{target}/{part}", None, 0, 0, row["log_day"] and date.fromisoformat(row["log_day"])))
        ci.remove(spark, row["path"])
    if root:
        ci.write_index(ci.local_rows(spark, entered, f"path string, record_day date, rows bigint, bad_rows bigint, {DAY} date"), root, f"scrub-{aside[-32:]}")


def scrub_history(spark: SparkSession, root: str, today: str, dry_run: bool = False, raw_root: str | None = None) -> DataFrame:
    """Redacts credentials in the raw chunks, the stored consolidated days and in everything derived from them.

    Returns the report (log_date, rows_scanned, rows_changed, needs_rewrite) of the consolidated tier,
    undated chunks included.  Only chunk days with changes are rewritten; today
    is left alone, it is still being written.  Flat columns, the daily tiers
    and, where they exist, the monthly ones are rebuilt from the clean entries
    rather than patched, so no copy of a secret survives in them.  With `raw_root` the chunks that
    the lake was built from are cleaned first.
    """
    use_utc(spark)
    index = ci.read_index(spark, root)
    past = read_history(spark, root, "consolidated", index).where(~F.col(DAY).eqNullSafe(F.to_date(F.lit(today))))
    report, _ = _stage(scrub_report(past.select(DAY, "entry"), "entry", [DAY]), "scrub-report")
    if dry_run:
        return report
    if raw_root:
        scrub_raw(spark, raw_root, today, root)
    dirty = ci.distinct_days(report.where("needs_rewrite"), DAY)
    if not dirty:
        return report

    def clean(days: DataFrame) -> DataFrame:
        return flatten_entries(scrub_entries(days, DAY)).select(*WIDE_COLUMNS, DAY)

    if index.isEmpty():  # a lake that predates the index
        periods = ci.distinct_days(past.where(ci.one_of(F.col(DAY), dirty)).select(F.to_date("ts").alias("period")), "period")
    else:
        periods = ci.distinct_days(index.where("rows > 0").where(ci.one_of(F.col(DAY), dirty)), "record_day")
    for scope in GRAINS:
        path = grain_path(root, "consolidated", scope)
        here = sorted(set(dirty) & set(ci.days_in(spark, path)), key=str)
        if here:
            rewrite_in_place(spark, path, clean, only=ci.local_rows(spark, [(d,) for d in here], f"{DAY} date"))
    for scope in GRAINS:
        if _stored(spark, grain_path(root, "sessions", scope)):
            rebuild(spark, root, scope, periods)
    return report


def verify_scrubbed(spark: SparkSession, root: str) -> DataFrame:
    """Chunk days of the consolidated tier that another scrub would still change; empty when clean."""
    entries = read_history(spark, root, "consolidated").select(DAY, "entry")
    return residual_secrets(entries, "entry", [DAY], scrub_json)


def verify_lake(spark: SparkSession, root: str, raw_root: str | None = None) -> DataFrame:
    """(place, residual_rows) of raw chunks and tiers, every grain, that another scrub would still change.

    Entries and raw lines are scrubbed as documents; a turn or session is put together as one
    document of its text columns first, so that no column is left out.
    """
    found = []
    if raw_root:
        found.append(read_raw(spark, raw_root).select(F.lit("raw").alias("place"), F.col("entry").alias("document")))
    for tier in TIERS:
        for scope, grain in GRAINS.items():
            path = grain_path(root, tier, scope)
            if _stored(spark, path):
                rows = spark.read.parquet(path)
                text = [F.col(c) for c, t in rows.dtypes if t == "string"]
                document = F.col("entry") if tier == "consolidated" else F.to_json(F.struct(*text))
                found.append(rows.select(F.lit(f"{tier}/{grain}").alias("place"), document.alias("document")))
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    return residual_secrets(every, "document", ["place"], scrub_json)
