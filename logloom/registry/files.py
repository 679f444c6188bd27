"""Queries on files: a lake built from raw chunks, its plans and its scrub, and every reader and writer.

The files are written from the test tables first, as the systems that make them
would, and then read by the reader under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.functions.scrub import scrub_json
from logloom.operators.ordering import position
from logloom.plans import jobs, lifecycle
from logloom.registry.base import LOG, ntz, query, turn_ctes, with_ctes, written_once
from logloom.registry.metrics import _COUNTERS
from logloom.registry.scoring import GRADES, QUESTIONS
from logloom.session import shared_dir
from logloom.sources import bench, chunk_index, providers, raw, tiers
from logloom.streaming import streams

# Lines as flushed: those of the last hour of a day are in a chunk of the next
# day, and some lines have a copy without a readable time.
FLUSHED = """
SELECT ts, type, request_id, entry,
  CASE WHEN hh = '23' THEN strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') ELSE day END AS log_day,
  CASE WHEN hh = '23' THEN '00' ELSE hh END AS hour
FROM (SELECT *, strftime(ts, '%H') AS hh FROM log_lines) l
UNION ALL
SELECT NULL, type, request_id, regexp_replace(entry, '"timestamp":"[^"]*"', '"timestamp":"soon"'), day, strftime(ts, '%H')
FROM log_lines WHERE type = 'system_prompt'
"""
FLUSH_CTE = f"flushed AS ({FLUSHED})"
SPLIT_DAY = "2024-01-16"
LISTING_TODAY = "2024-01-30"


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.log_lines(spark, sf_dir).select("ts", "type", "day", "entry")
    late = F.hour("ts") == 23
    dated = lines.select(
        "entry", F.when(late, F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd")).otherwise(F.col("day")).alias("log_day"),
        F.when(late, "00").otherwise(F.date_format("ts", "HH")).alias("hour"),
    )
    undated = lines.where("type = 'system_prompt'").select(
        F.regexp_replace("entry", '"timestamp":"[^"]*"', '"timestamp":"soon"').alias("entry"), F.col("day").alias("log_day"),
        F.date_format("ts", "HH").alias("hour"),
    )
    return dated.unionAll(undated)


LINES_OF_A_TASK = 250_000


def _write_chunks(lines: DataFrame, path: str) -> None:
    named = lines.select(F.col("entry").alias("value"), "log_day", F.concat("hour", F.lit("-00-00-host-1-a.jsonl")).alias("chunk"))
    tasks = lines.count() // LINES_OF_A_TASK + 1
    many = tasks > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by hash: a chunk is in one task by range as well, and ranges would work out every line twice
    dealt = named.repartition(tasks, "log_day", "chunk") if many else named.repartition("log_day", "chunk")
    dealt.write.partitionBy("log_day", "chunk").text(path)


def _chunks(spark: SparkSession, sf_dir: str) -> str:
    return written_once(spark, sf_dir, "flushed-chunks", lambda path: _write_chunks(_flushed(spark, sf_dir), path))


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake from two consolidations of consecutive chunk days, and a month build."""

    def write(root: str) -> None:
        lines = raw.read_raw(spark, _chunks(spark, sf_dir))
        for part in (F.col("log_day") < SPLIT_DAY, F.col("log_day") >= SPLIT_DAY):
            jobs.consolidate(spark, lines.where(part), root)
        jobs.rebuild(spark, root, "month")

    return written_once(spark, sf_dir, "lake", write)


@query(
    "consolidate_days",
    with_ctes(LOG, FLUSH_CTE, body="SELECT log_day AS day, ts, type, request_id, entry FROM flushed"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over consecutive days lose and double nothing, late and undated lines included."""
    tier = tiers.read_tier(spark, _lake(spark, sf_dir), "consolidated")
    return ntz(tier.select(F.date_format("log_date", "yyyy-MM-dd").alias("day"), "ts", "type", "request_id", "entry"), "ts")


_KEYS = "session_key, turn_idx, request_id, request_ts, response_ts, model"


@query("daily_turn_tier", with_ctes(*turn_ctes("day"), body=f"SELECT strftime(request_ts, '%Y-%m-%d') AS day, {_KEYS} FROM turns"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a day and a month build the default grain holds every turn once."""
    turns = tiers.read_tier(spark, _lake(spark, sf_dir), "sessions")
    return ntz(turns.select(F.date_format("log_date", "yyyy-MM-dd").alias("day"), *_KEYS.split(", ")), "request_ts", "response_ts")


@query(
    "monthly_sessions_tier",
    with_ctes(*turn_ctes("month"), body="SELECT session_key, count(*) AS turns, count(*) - count(response_ts) AS unanswered_turns FROM turns GROUP BY session_key, period"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.read_tier(spark, _lake(spark, sf_dir), "session-rollup", "monthly").select("session_key", "turns", "unanswered_turns")


def _own_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, chunks = _lake(spark, sf_dir), _chunks(spark, sf_dir)
    tiers_part = lifecycle.relative_to(providers.list_objects(spark, lake), lake)
    return tiers_part.unionAll(lifecycle.relative_to(providers.list_objects(spark, chunks), chunks))


@query(
    "plan_own_lake",
    with_ctes(
        *turn_ctes("day"), FLUSH_CTE, "con AS (SELECT DISTINCT log_day AS day FROM flushed)",
        "ses AS (SELECT DISTINCT strftime(request_ts, '%Y-%m-%d') AS day FROM turns)",
        body=f"""SELECT 'sweep' AS action, day FROM con SEMI JOIN ses USING (day) WHERE day <> '{LISTING_TODAY}'
          UNION ALL SELECT 'build_turns', day FROM con ANTI JOIN ses USING (day)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans see the tiers that the library wrote: nothing is pending, finished days may be swept."""
    listing = _own_listing(spark, sf_dir)
    pending = lifecycle.plan_consolidation(listing, LISTING_TODAY).select(F.lit("consolidate").alias("action"), "day")
    sweep = lifecycle.plan_sweep(listing, LISTING_TODAY).select(F.lit("sweep").alias("action"), "day").distinct()
    return pending.unionAll(lifecycle.plan_backfill(listing, LISTING_TODAY)).unionAll(sweep)


@query(
    "list_files",
    with_ctes(LOG, FLUSH_CTE, body="SELECT log_day AS day, count(DISTINCT hour) AS hours, sum(strlen(entry) + 1)::BIGINT AS bytes FROM flushed GROUP BY log_day"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files, listed: hours and bytes of the raw chunks by day."""
    root = _chunks(spark, sf_dir)
    chunks = lifecycle.raw_objects(lifecycle.relative_to(providers.list_objects(spark, root), root))
    hours = F.count_distinct(raw.chunk_hour(F.col("path"))).alias("hours")
    return chunks.groupBy("day").agg(hours, F.sum("length").alias("bytes"))


@query(
    "list_prefixes",
    with_ctes(LOG, FLUSH_CTE, body="SELECT log_day AS day, count(DISTINCT hour) AS hours, sum(strlen(entry) + 1)::BIGINT AS bytes FROM flushed GROUP BY log_day"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, listed by the tasks, a day's folder each."""
    root = _chunks(spark, sf_dir)
    chunks = lifecycle.raw_objects(lifecycle.relative_to(providers.list_prefixes(spark, root), root))
    hours = F.count_distinct(raw.chunk_hour(F.col("path"))).alias("hours")
    return chunks.groupBy("day").agg(hours, F.sum("length").alias("bytes"))


# Credentials in flat fields of dated lines and in undated ones.
LEAKS = (('"user_message_this_turn":"m', '"user_message_this_turn":"password=hush'), ('"timestamp":"soon"', '"timestamp":"soon","note":"token : hush"'))


def _leaky(column: str) -> str:
    for clean, leak in LEAKS:
        column = f"replace({column}, '{clean}', '{leak}')"
    return column


@query(
    "scrub_history",
    with_ctes(
        LOG, FLUSH_CTE,
        body=f"""SELECT log_day AS day, count(*) AS rows_scanned, count(*) FILTER (WHERE {_leaky('entry')} <> entry) AS rows_changed,
          0::BIGINT AS residual FROM flushed GROUP BY log_day""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake with credentials in dated, late and undated lines and in both grains; none is left in any tier."""
    root, source = shared_dir(spark, "leaky-lake"), shared_dir(spark, "leaky-chunks")
    lines = _flushed(spark, sf_dir)
    for clean, leak in LEAKS:
        lines = lines.withColumn("entry", F.replace("entry", F.lit(clean), F.lit(leak)))
    _write_chunks(lines, source)
    jobs.consolidate(spark, raw.read_raw(spark, source), root)
    jobs.rebuild(spark, root, "month")
    report = jobs.scrub_history(spark, root, "2030-01-01")
    left = None
    for tier in tiers.TIERS:
        for grain in ("daily",) if tier == "consolidated" else ("daily", "monthly"):
            rows = tiers.read_tier(spark, root, tier, grain).select(F.to_json(F.struct("*")).alias("row"))
            left = rows if left is None else left.unionAll(rows)
    residual = left.agg(F.count_if(F.col("row").contains("hush")).alias("residual"))
    return report.select(F.date_format("log_date", "yyyy-MM-dd").alias("day"), "rows_scanned", "rows_changed").crossJoin(residual)


# One chunk of this day is withdrawn: the day is delivered again without it.
REPLACED_DAY, WITHDRAWN_HOUR = "2024-01-10", "05"
KEPT = f"NOT (log_day = '{REPLACED_DAY}' AND hour = '{WITHDRAWN_HOUR}')"
KEPT_LINES = f"log_lines AS (SELECT * FROM all_lines WHERE NOT (day = '{REPLACED_DAY}' AND strftime(ts, '%H') = '{WITHDRAWN_HOUR}'))"


def _redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw.read_raw(spark, _chunks(spark, sf_dir)).where(F.col("log_day") == REPLACED_DAY)
    return lines.where(F.col("log_hour") != int(WITHDRAWN_HOUR))


@query(
    "rebuild_after_late",
    with_ctes(
        f"all_lines AS ({fx.LOG_LINES})", KEPT_LINES, *turn_ctes("month")[1:],
        body="SELECT session_key, strftime(min(request_ts), '%Y-%m-%d') AS day, count(*) AS turns FROM turns GROUP BY session_key, period",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months built from the later half first: then the earlier half comes, and one day loses a chunk.

    Every session moves to its earlier start and none is doubled.
    """
    root = shared_dir(spark, "late-lake")
    lines = raw.read_raw(spark, _chunks(spark, sf_dir))
    for part in (F.col("log_day") >= SPLIT_DAY, F.col("log_day") < SPLIT_DAY):
        jobs.consolidate(spark, lines.where(part), root)
        jobs.rebuild_pending(spark, root, "month")
    jobs.consolidate(spark, _redelivered(spark, sf_dir), root)
    jobs.rebuild_pending(spark, root, "month")
    sessions = tiers.read_tier(spark, root, "session-rollup", "monthly")
    return sessions.select("session_key", F.date_format("log_date", "yyyy-MM-dd").alias("day"), "turns")


def _stream_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake that a stream and batch runs have filled by turns; nothing is rebuilt after the stream."""

    def write(root: str) -> None:
        source, checkpoint = _chunks(spark, sf_dir), shared_dir(spark, "lake-stream")
        lines = raw.read_raw(spark, source)
        jobs.consolidate(spark, lines.where(F.col("log_day") >= SPLIT_DAY), root)
        # the days the batch has brought add nothing, nor does a second stream that begins anew
        for name in ("live", "again"):
            streams.stream_to_lake(spark, source, root, f"{checkpoint}/{name}", name).awaitTermination()

    return written_once(spark, sf_dir, "stream-lake", write)


@query(
    "stream_then_batch",
    with_ctes(LOG, FLUSH_CTE, body="SELECT log_day AS day, ts, type, request_id, entry FROM flushed"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = tiers.read_tier(spark, _stream_lake(spark, sf_dir), "consolidated")
    return ntz(tier.select(F.date_format("log_date", "yyyy-MM-dd").alias("day"), "ts", "type", "request_id", "entry"), "ts")


@query(
    "pending_periods",
    with_ctes(
        LOG, FLUSH_CTE,
        "f AS (SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'undated') AS period, log_day FROM flushed)",
        f"""b AS (SELECT period, count(*) AS built_from FROM f WHERE log_day >= '{SPLIT_DAY}' GROUP BY period)""",
        body="""SELECT period, count(*) AS entries, any_value(b.built_from) AS built_from FROM f LEFT JOIN b USING (period) GROUP BY period
          HAVING count(*) IS DISTINCT FROM any_value(b.built_from)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record days whose records the stream has added to: told from the chunk index and the manifest alone."""
    return jobs.stale_periods(spark, _stream_lake(spark, sf_dir))


@query(
    "chunk_index",
    with_ctes(
        LOG, FLUSH_CTE,
        body="SELECT log_day AS day, strftime(ts, '%Y-%m-%d') AS record_day, count(*) AS rows, count(DISTINCT hour) AS chunks FROM flushed GROUP BY 1, 2",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record days the chunks of a day hold, from the lake's own index."""
    index = chunk_index.read_index(spark, _lake(spark, sf_dir)).where("rows > 0")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    chunk = F.regexp_extract("path", "chunk=([^/]+)", 1)
    return index.groupBy(day("log_date").alias("day"), day("record_day").alias("record_day")).agg(F.sum("rows").alias("rows"), F.count_distinct(chunk).alias("chunks"))


@query(
    "read_history",
    with_ctes(LOG, FLUSH_CTE, body=f"SELECT log_day AS day, ts, type, request_id, entry FROM flushed WHERE {KEPT}"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months stand in for the days that the plan of superseded files names; a day delivered again counts beside its month."""
    root = shared_dir(spark, "month-lake")
    jobs.consolidate(spark, raw.read_raw(spark, _chunks(spark, sf_dir)), root)
    jobs.compact_months(spark, root)
    listing = lifecycle.relative_to(providers.list_objects(spark, root), root)
    for tier, day in lifecycle.plan_superseded(listing).collect():  # days of the calendar
        chunk_index.remove(spark, f"{root}/{tier}/daily/log_date={day}")
    jobs.consolidate(spark, _redelivered(spark, sf_dir), root)
    rows = jobs.read_history(spark, root, "consolidated")
    return ntz(rows.select(F.date_format("log_date", "yyyy-MM-dd").alias("day"), "ts", "type", "request_id", "entry"), "ts")


def _redacted(column: str) -> str:
    return f"regexp_replace(regexp_replace({_leaky(column)}, 'password=hush[0-9]*', 'password=[REDACTED]'), '(token.: )hush', '\\1[REDACTED]')"


@query(
    "scrub_raw",
    with_ctes(LOG, FLUSH_CTE, body=f"SELECT log_day AS day, cast(hour AS int) AS hour, {_redacted('entry')} AS entry, 0::BIGINT AS residual FROM flushed"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chunks with credentials, swapped in place: every line is there once, clean, below its day and hour."""
    root, source = shared_dir(spark, "scrubbed-lake"), shared_dir(spark, "scrubbed-raw")
    lines = _flushed(spark, sf_dir)
    for clean, leak in LEAKS:
        lines = lines.withColumn("entry", F.replace("entry", F.lit(clean), F.lit(leak)))
    _write_chunks(lines, source)
    jobs.consolidate(spark, raw.read_raw(spark, source), root)
    jobs.scrub_history(spark, root, "2030-01-01", raw_root=source)
    left = jobs.verify_lake(spark, root, source).agg(F.coalesce(F.sum("residual_rows"), F.lit(0)).alias("n")).first()[0]
    return raw.read_raw(spark, source).select(
        F.date_format("log_day", "yyyy-MM-dd").alias("day"), F.col("log_hour").alias("hour"), "entry", F.lit(left).cast("long").alias("residual")
    )


@query(
    "rewrite_jsonl_lines",
    with_ctes(
        f"s AS ({fx.SECRET_RECORDS})",
        """t AS (SELECT concat('2024-01-', lpad(cast(event_id % 28 + 1 AS varchar), 2, '0')) AS log_day, cast(event_id % 3 + 14 AS int) AS log_hour,
             event_id, entry, expected FROM s)""",
        """c AS (SELECT log_day, log_hour FROM t WHERE entry <> expected GROUP BY 1, 2)""",
        body="""SELECT log_day, log_hour, row_number() OVER (PARTITION BY log_day, log_hour ORDER BY event_id) AS line, expected AS entry
          FROM t SEMI JOIN c USING (log_day, log_hour)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten chunks read back like raw ones: day, hour and every line in its place."""
    hour = (F.col("event_id") % 3 + 14).cast("string")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"))
    lines = fx.secret_records(spark, sf_dir).select(
        "entry", F.concat(day, F.lit("/"), hour, F.lit("-00-00-host-1-a.jsonl")).alias("path"), F.col("event_id").alias("position")
    )
    out = shared_dir(spark, "rewritten-chunks")
    tiers.rewrite_jsonl(spark, lines, scrub_json, out)
    # the parts of a chunk follow each other, and so do the rows of a part
    back = raw.read_raw(spark, out).withColumn("part", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))
    keyed = back.select(F.date_format("log_day", "yyyy-MM-dd").alias("log_day"), "log_hour", "part", "position", "entry")
    order = [F.col("part").asc(), F.col("position").asc()]
    return position(keyed, ["log_day", "log_hour"], order, F.col("part"), "line").select("log_day", "log_hour", "line", "entry")


# ---- benchmark and provider files ------------------------------------------


def _files(spark: SparkSession, sf_dir: str, label: str, lines: DataFrame, *by: str) -> str:
    """Text lines as files, one folder per value of `by`."""
    return written_once(spark, sf_dir, label, lambda path: lines.repartitionByRange(*(by or ("value",))).write.partitionBy(*by).text(path))


def _rename(spark: SparkSession, root: str, ending: str) -> None:
    """Folders `key=<name>` that a partitioned write has made become `<name><ending>`; there are as many as keys."""
    for name in chunk_index.names_in(spark, root):
        if "=" in name:
            chunk_index.move(spark, f"{root}/{name}", f"{root}/{name.split('=', 1)[1]}{ending}")


TRIALS = """SELECT cast(event_id % 30 AS int) AS trial, concat('q', cast(event_id % 5 + 1 AS varchar(20))) AS question, event_type AS model, value AS elapsed_s,
  CASE WHEN value < 4 THEN concat('request timed out after ', cast(event_id AS varchar(20)), 'ms') ELSE NULL END AS error,
  cast(event_id AS int) AS answer_len FROM events """


APP_TRIALS = TRIALS.replace("SELECT cast", "SELECT concat('app', cast(user_id % 7 AS varchar(20))) AS app, cast", 1)


@query("read_trials", APP_TRIALS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial summaries written as tab-separated reports with a header, one per app and named after it, then read."""
    columns = summary_columns()

    def write(path: str) -> None:
        rows = fx.run_view(spark, sf_dir, APP_TRIALS, "events")
        full = rows.select("app", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))
        tiers.report_text(full).write.partitionBy("app").option("sep", "\t").option("header", "true").option("emptyValue", "").csv(path)
        _rename(spark, path, ".summary.tsv")

    got = bench.read_trials(spark, written_once(spark, sf_dir, "trial-reports", write))
    return got.select("app", F.col("trial").cast("int").alias("trial"), "question", "model", "elapsed_s", "error", F.col("answer_len").cast("int").alias("answer_len"))


def summary_columns() -> list[str]:
    from logloom.schemas import TRIAL_SUMMARY

    return [field.split()[0] for field in TRIAL_SUMMARY.split(",")]


@query("write_report", f"SELECT trial, question, model, coalesce(left(replace(error, chr(9), ' '), {tiers.REPORT_ERROR_CHARS}), '') AS error FROM ({TRIALS}) t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report, read as plain text."""
    def write(path: str) -> None:
        rows = fx.run_view(spark, sf_dir, TRIALS, "events").select("trial", "question", "model", "error")
        tiers.write_report(rows, path)

    lines = spark.read.text(written_once(spark, sf_dir, "error-reports", write)).where("NOT startswith(value, 'trial\t')")
    part = F.split("value", "\t", -1)
    return lines.select(part[0].cast("int").alias("trial"), part[1].alias("question"), part[2].alias("model"), part[3].alias("error"))


_GRADED = f"SELECT prefix, cast(score AS double) AS score FROM ({GRADES}) g"


@query("read_grades", f"SELECT prefix AS session_id, 'wet' AS app, 'q1' AS q_idx, 'm' AS model, 'ok' AS status, score FROM ({_GRADED}) x")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        rows = fx.run_view(spark, sf_dir, GRADES, "events").select(
            F.col("prefix").alias("session_id"), F.lit("wet").alias("app"), F.lit("q1").alias("q_idx"), F.lit("m").alias("model"),
            F.lit("ok").alias("status"), F.col("score").cast("double").alias("score"),
        )
        rows.write.option("sep", "\t").option("header", "true").csv(path)

    return bench.read_grades(spark, written_once(spark, sf_dir, "grades", write))


@query("read_raw_grades", f"SELECT prefix, score FROM ({_GRADED}) x WHERE score IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = fx.run_view(spark, sf_dir, GRADES, "events").where("score IS NOT NULL")
    lines = graded.select(F.concat_ws(" ", "prefix", F.col("score").cast("double").cast("string")).alias("value"))
    return bench.read_raw_grades(spark, _files(spark, sf_dir, "raw-grades", lines))


@query("read_questions", f"SELECT DISTINCT app, cast(dense_rank() OVER (PARTITION BY app ORDER BY question) AS int) AS q_idx, question FROM ({QUESTIONS}) q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per app with comments and blank lines between its questions."""
    def write(path: str) -> None:
        asked = fx.run_view(spark, sf_dir, QUESTIONS, "events").select("app", "question").distinct()
        text = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("# about\n\n  "), "question"))), "\n")
        files = asked.groupBy("app").agg(text.alias("value"))
        files.write.partitionBy("app").text(path)
        for name in chunk_index.names_in(spark, path):  # one file per app, named after it
            for part in chunk_index.names_in(spark, f"{path}/{name}") if name.startswith("app=") else []:
                chunk_index.move(spark, f"{path}/{name}/{part}", f"{path}/files/{name[4:]}.txt")

    return bench.read_questions(spark, written_once(spark, sf_dir, "questions", write) + "/files")


@query(
    "read_golden",
    "SELECT concat('g', item_id) AS id, CASE WHEN item_id % 3 = 0 THEN 'clarify' ELSE 'answer' END AS mode, CASE WHEN item_id % 2 = 0 THEN item_id / 8.0::DOUBLE END AS accuracy FROM benchmark",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        items = fx.table(spark, sf_dir, "benchmark")
        row = F.struct(
            F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("id"), F.when(F.col("item_id") % 3 == 0, "clarify").otherwise("answer").alias("mode"),
            F.when(F.col("item_id") % 2 == 0, F.col("item_id") / 8.0).alias("bench_mean_acc"),
        )
        document = F.to_json(F.struct(F.lit("1").alias("version"), F.collect_list(row).alias("questions"))).alias("value")
        manifests = items.groupBy(F.floor(F.col("item_id") / 1000).alias("part")).agg(document).select("value")
        manifests.write.option("maxRecordsPerFile", 1).text(path)  # a document per file

    return bench.read_golden(spark, written_once(spark, sf_dir, "golden", write)).select("id", "mode", "accuracy")


@query(
    "read_transcripts",
    """SELECT concat('q', event_id % 5 + 1) AS q_idx, event_type AS file_model, cast(event_id % 30 AS int) AS file_trial, concat('vendor/', event_type) AS model,
      cast(event_id % 4 AS int) AS turns, concat('answer ', event_id) AS response FROM events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in files named by question, model and trial; a cell's runs are in several files, by ranges of ids."""
    def write(path: str) -> None:
        turn = F.struct(F.lit(1).alias("turn"), F.lit("call").alias("type"), F.lit("query").alias("name"))
        run = F.struct(
            F.concat(F.lit("vendor/"), "event_type").alias("model"), (F.col("event_id") % 30).alias("trial"),
            F.array_repeat(turn, (F.col("event_id") % 4).cast("int")).alias("turns"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("response"),
        )
        name = F.format_string("q%d__%s__t%d.json", (F.col("event_id") % 5 + 1).cast("int"), "event_type", (F.col("event_id") % 30).cast("int"))
        part = F.floor(F.col("event_id") / 100_000).alias("part")
        runs = fx.table(spark, sf_dir, "events").groupBy(name.alias("run"), part).agg(F.to_json(F.collect_list(run)).alias("value")).drop("part")
        # the writer needs a run's documents in one task, but one file each
        runs.repartition("run").write.option("maxRecordsPerFile", 1).partitionBy("run").text(path)

    path = written_once(spark, sf_dir, "transcripts", write)
    return bench.read_transcripts(spark, path).select(
        "q_idx", "file_model", "file_trial", "model", F.size("turns").alias("turns"), "response"
    )


@query(
    "read_providers",
    """WITH p AS (SELECT DISTINCT p_brand AS provider FROM part)
    SELECT provider, cast(row_number() OVER (ORDER BY provider) - 1 AS int) AS position, 2 AS models, CASE WHEN right(provider, 1) IN ('1', '3') THEN 1 ELSE 2 END AS prefixes,
      provider = (SELECT max(provider) FROM p) AS is_default FROM p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider configuration with one provider per brand; some declare prefixes of their own."""
    def write(path: str) -> None:
        brands = fx.table(spark, sf_dir, "part").select("p_brand").distinct()
        own = F.right("p_brand", F.lit(1)).isin("1", "3")
        config = F.struct(
            F.array(F.lit("a"), F.lit("b")).alias("models"), F.when(own, F.array(F.concat("p_brand", F.lit("/")))).alias("model_prefixes")
        )
        entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_brand", config.alias("c")))))
        one = brands.agg(F.to_json(F.struct(F.max("p_brand").alias("default_provider"), entries.alias("providers"))).alias("value"))
        one.write.text(path)

    got = providers.read_providers(spark, written_once(spark, sf_dir, "providers", write))
    return got.select("provider", "position", F.size("models").alias("models"), F.size("prefixes").alias("prefixes"), "is_default")


@query("read_counters", with_ctes(*_COUNTERS, body="SELECT model, metric, count(*) AS samples, sum(value) AS total FROM samples GROUP BY model, metric"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_once(spark, sf_dir, "counter-files", lambda p: fx.counters(spark, sf_dir).write.parquet(p))
    return providers.read_counters(spark, path).groupBy("model", "metric").agg(F.count("*").alias("samples"), F.sum("value").alias("total"))
