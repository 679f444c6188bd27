"""Queries on scrubbing, repair, provenance and tier plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.functions.scrub import scrub_json, scrub_text
from logloom.operators import quality
from logloom.plans import lifecycle
from logloom.registry.base import query, with_ctes
from logloom.registry.capture import scrub_sql
from logloom.session import shared_dir
from logloom.sources import raw, tiers

_CLEAN = scrub_sql("text")


@query("scrub_text", f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scrub_column(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("verify_scrubbed", f"SELECT source, count(*) AS residual_rows FROM documents WHERE {_CLEAN} <> text GROUP BY source")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.residual_secrets(fx.table(spark, sf_dir, "documents"), "text", ["source"])


@query("verify_after_scrub", "SELECT source, count(*) AS residual_rows FROM documents WHERE false GROUP BY source")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty: a scrubbed table is a fixed point of the scrub."""
    done = quality.scrub_column(fx.table(spark, sf_dir, "documents"), "text", scrub_text)
    return quality.residual_secrets(done, "text", ["source"])


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.secret_records(spark, sf_dir)


@query("scrub_json", f"SELECT event_id, expected AS entry FROM ({fx.SECRET_RECORDS}) s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets(spark, sf_dir).select("event_id", scrub_json(F.col("entry")).alias("entry"))


@query(
    "scrub_report",
    f"""SELECT source, count(*) AS rows_scanned, count(*) FILTER (WHERE entry <> expected) AS rows_changed,
      count(*) FILTER (WHERE entry <> expected) > 0 AS needs_rewrite FROM ({fx.SECRET_RECORDS}) s GROUP BY source""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scrub_report(_secrets(spark, sf_dir), "entry", ["source"])


@query(
    "rewrite_jsonl",
    f"""SELECT concat('2024-01-', lpad(cast(event_id % 28 + 1 AS varchar), 2, '0')) AS day, count(*) AS lines,
      count(*) FILTER (WHERE entry <> expected) AS changed_lines FROM ({fx.SECRET_RECORDS}) s GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chunks of 28 days, each line scrubbed; reports lines and changed lines per day."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"))
    lines = _secrets(spark, sf_dir).select("entry", F.concat(day, F.lit("/14-00-00-host-1-a.jsonl")).alias("path"))
    report = tiers.rewrite_jsonl(spark, lines, scrub_json, shared_dir(spark, "scrubbed-chunks"))
    return report.select(F.left("path", F.lit(10)).alias("day"), "lines", "changed_lines")


@query("repair_tool_args", f"SELECT event_id, expected AS arguments, event_id % 5 <> 0 AS repaired FROM ({fx.TOOL_ARGS}) a")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repair_arguments(fx.tool_args(spark, sf_dir)).select("event_id", "arguments", "repaired")


@query(
    "repair_rate",
    f"""SELECT model, count(*) AS calls, count(*) FILTER (WHERE event_id % 5 <> 0) AS repaired_calls FROM ({fx.TOOL_ARGS}) a GROUP BY model""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = quality.repair_arguments(fx.tool_args(spark, sf_dir))
    return fixed.groupBy("model").agg(F.count("*").alias("calls"), F.count_if("repaired").alias("repaired_calls"))


@query(
    "provenance",
    with_ctes(
        f"v AS ({fx.VERSION_LINES})",
        """p AS (SELECT DISTINCT job, json_extract_string(doc, '$.agent') AS agent, json_extract_string(doc, '$.app_sha') AS app_sha,
             json_extract_string(doc, '$.proxy_sha') AS proxy_sha
           FROM (SELECT job, substr(line, 20) AS doc FROM v WHERE line LIKE '##BENCH-VERSIONS## %') x)""",
        body="""SELECT job, agent, app_sha, proxy_sha,
          concat_ws(',', CASE WHEN agent IN ('', 'unknown') THEN 'agent' END, CASE WHEN app_sha IN ('', 'unknown') THEN 'app_sha' END) AS unresolved,
          agent NOT IN ('', 'unknown') AND app_sha NOT IN ('', 'unknown') AS valid FROM p""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.provenance_check(fx.run_view(spark, sf_dir, fx.VERSION_LINES, "customer"))


# ---- tier plans ------------------------------------------------------------

TODAY = fx.LISTING_TODAY
_OBJECTS = (fx.OBJECT_PARTS, f"objects AS ({fx.OBJECTS})")
_SETS = (
    "src AS (SELECT path FROM objects WHERE side = 'source')",
    "raw_d AS (SELECT DISTINCT left(path, 10) AS day FROM src WHERE regexp_matches(path, '^[0-9]{4}-[0-9]{2}-[0-9]{2}/'))",
    "con AS (SELECT regexp_extract(path, '([^/]+)\\.parquet$', 1) AS day FROM src WHERE path LIKE 'consolidated/daily/%')",
    "ses AS (SELECT regexp_extract(path, '([^/]+)\\.parquet$', 1) AS day FROM src WHERE path LIKE 'sessions/daily/%')",
    "rol AS (SELECT regexp_extract(path, '([^/]+)\\.parquet$', 1) AS day FROM src WHERE path LIKE 'session-rollup/daily/%')",
    f"todo AS (SELECT day FROM raw_d WHERE day <> '{TODAY}' EXCEPT SELECT day FROM con)",
)


def _side(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return fx.objects(spark, sf_dir).where(F.col("side") == side)


@query("plan_consolidation", with_ctes(*_OBJECTS, *_SETS, body="SELECT day FROM todo"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan_consolidation(_side(spark, sf_dir, "source"), TODAY)


@query(
    "plan_backfill",
    with_ctes(
        *_OBJECTS, *_SETS,
        body="""SELECT 'build_turns' AS action, day FROM (SELECT day FROM con EXCEPT SELECT day FROM ses EXCEPT SELECT day FROM todo) a
          UNION ALL SELECT 'build_rollup', day FROM (SELECT day FROM ses EXCEPT SELECT day FROM rol EXCEPT SELECT day FROM todo) b""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan_backfill(_side(spark, sf_dir, "source"), TODAY)


@query(
    "plan_sweep",
    with_ctes(
        *_OBJECTS, *_SETS,
        body=f"""SELECT left(path, 10) AS day, path FROM src WHERE left(path, 10) IN (SELECT day FROM raw_d WHERE day <> '{TODAY}')
          AND left(path, 10) IN (SELECT day FROM con) AND left(path, 10) IN (SELECT day FROM ses)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan_sweep(_side(spark, sf_dir, "source"), TODAY)


@query(
    "plan_prune",
    with_ctes(
        *_OBJECTS,
        "mir AS (SELECT path FROM objects WHERE side = 'mirror')",
        body=f"""SELECT left(path, 10) AS day, path FROM mir WHERE regexp_matches(path, '^[0-9]{{4}}-') AND left(path, 10) <> '{TODAY}'
          AND EXISTS (SELECT 1 FROM mir c WHERE c.path = concat('consolidated/daily/', left(mir.path, 10), '.parquet'))
          AND EXISTS (SELECT 1 FROM mir s WHERE s.path = concat('sessions/daily/', left(mir.path, 10), '.parquet'))""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.plan_prune(_side(spark, sf_dir, "mirror"), TODAY)


@query(
    "mirror_diff",
    with_ctes(
        *_OBJECTS,
        body="""SELECT s.path, cast(s.length AS bigint) AS length, CASE WHEN m.path IS NULL THEN 'missing' ELSE 'changed' END AS reason
          FROM (SELECT * FROM objects WHERE side = 'source' AND path NOT LIKE 'notes/%') s
          LEFT JOIN (SELECT * FROM objects WHERE side = 'mirror') m USING (path)
          WHERE m.path IS NULL OR m.tag IS DISTINCT FROM s.mtime OR m.length IS DISTINCT FROM s.length""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mirrored = _side(spark, sf_dir, "source").where(~F.col("path").startswith("notes/"))
    return lifecycle.mirror_diff(mirrored, _side(spark, sf_dir, "mirror"))


@query(
    "list_objects",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT strftime(ts, '%H')) AS hours FROM events GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and hours of the raw chunks, from their names alone."""
    chunks = lifecycle.raw_objects(_side(spark, sf_dir, "source"))
    return chunks.select("day", raw.chunk_hour(F.col("path")).alias("h")).groupBy("day").agg(F.count_distinct("h").alias("hours"))
