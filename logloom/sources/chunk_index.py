"""What a lake knows about itself: which chunks are in it, which days they hold, which periods were built.

Both tables are small: a chunk holds records of a day or two, and a period has one row per
day it is filed under.

``<root>/chunk-index/log_date=<chunk day>/writer=<who>`` has (path, record_day, rows, bad_rows): one
row per chunk and day of its records.  It is the ledger of what has been consolidated, and by it a
rebuild finds the few chunk days that hold the records of a day.

``<root>/manifest/tier=<tier>/grain=<grain>/period=<first day>`` has (filed, rows, entries): the
partitions that the last build of a period owns, their rows, and how many indexed records it
was built from.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DAY = "log_date"
INDEX_SCHEMA = f"path string, record_day date, rows bigint, bad_rows bigint, {DAY} date, writer string"
MANIFEST_SCHEMA = "filed date, rows bigint, entries bigint, tier string, grain string, period string"
BATCH_WRITER = "consolidate"
UNDATED = "undated"
# Writes that replace the folders they bring and leave the others.
DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of ours, on whatever file system it is."""
    target, files = _path(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file, with the folders above its new place."""
    old, files = _path(spark, source)
    new, _ = _path(spark, target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise RuntimeError(f"{source} could not be moved to {target}")


def entries_in(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names directly below a folder and whether each is a folder; none where there is no folder."""
    target, files = _path(spark, path)
    found = files.listStatus(target) if files.exists(target) and files.getFileStatus(target).isDirectory() else []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in found)


def names_in(spark: SparkSession, path: str) -> list[str]:
    return [name for name, _ in entries_in(spark, path)]


def size_of(spark: SparkSession, path: str) -> int:
    target, files = _path(spark, path)
    return files.getContentSummary(target).getLength()


def folder_of(day: date | None) -> str:
    return f"{DAY}={day.isoformat() if day else '__HIVE_DEFAULT_PARTITION__'}"


def days_in(spark: SparkSession, path: str) -> list[date | None]:
    """The days that a table has folders for; None is the undated one."""
    prefix, out = f"{DAY}=", []
    for name in names_in(spark, path):
        if name.startswith(prefix):
            text = name[len(prefix) :]
            out.append(None if text == "__HIVE_DEFAULT_PARTITION__" else date.fromisoformat(text))
    return out


def one_of(column: Column, days: Iterable[date | None]) -> Column:
    """Whether a day is one of a list, as a condition that prunes folders and row groups."""
    days = list(days)
    hit = column.isin([d for d in days if d is not None]) if any(d is not None for d in days) else F.lit(False)
    return hit | column.isNull() if None in days else hit


def period_start(day: date | None, scope: str) -> date | None:
    return day if day is None or scope == "day" else day.replace(day=1)


def distinct_days(df: DataFrame, column: str) -> list[date | None]:
    """The days in a column: no more than the calendar has, however large the table."""
    return sorted((r[0] for r in df.select(column).distinct().collect()), key=lambda d: (d is None, d or date.min))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of our own as a frame, without Python workers."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing there yet
        return local_rows(spark, [], schema)


# ---- the chunk index ---------------------------------------------------------


def index_path(root: str) -> str:
    return f"{root.rstrip('/')}/chunk-index"


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, index_path(root), INDEX_SCHEMA)


def index_rows(parsed: DataFrame, good: Column) -> DataFrame:
    """Index rows of parsed lines that have `path`, `log_date` and `ts`."""
    day = F.when(good, F.to_date("ts")).alias("record_day")
    return parsed.groupBy("path", DAY, day).agg(F.count_if(good).alias("rows"), F.count_if(~good).alias("bad_rows"))


def write_index(rows: DataFrame, root: str, writer: str) -> None:
    """Replaces the index rows of a writer for the chunk days that `rows` brings."""
    named = rows.select("path", "record_day", "rows", "bad_rows", DAY, F.lit(writer).alias("writer"))
    named.coalesce(1).write.mode("overwrite").options(**DYNAMIC).partitionBy(DAY, "writer").parquet(index_path(root))


def drop_other_writers(spark: SparkSession, root: str, days: Iterable[date | None], writer: str) -> None:
    """After a writer has taken over whole chunk days, the entries of all others for them go."""
    for day in days:
        folder = f"{index_path(root)}/{folder_of(day)}"
        for name in names_in(spark, folder):
            if name.startswith("writer=") and name != f"writer={writer}":
                remove(spark, f"{folder}/{name}")


def records_by_period(index: DataFrame, scope: str, by: str = "record_day") -> DataFrame:
    """(period, entries): indexed records per period; undated records are one period."""
    day = F.col(by) if scope == "day" else F.trunc(by, "month")
    period = F.coalesce(day.cast("string"), F.lit(UNDATED))
    return index.where("rows > 0").groupBy(period.alias("period")).agg(F.sum("rows").alias("entries"))


# ---- the manifest of built periods -------------------------------------------


def manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}/manifest"


def read_manifest(spark: SparkSession, root: str, tier: str, grain: str) -> DataFrame:
    stored = _stored(spark, manifest_path(root), MANIFEST_SCHEMA)
    return stored.where((F.col("tier") == tier) & (F.col("grain") == grain))


def write_manifest(spark: SparkSession, root: str, grain: str, owned: list[tuple[str, str, date | None, int, int]]) -> None:
    """Replaces the entries (tier, period, filed, rows, entries) of the periods that were built."""
    if owned:
        rows = [(filed, n, entries, tier, grain, period) for tier, period, filed, n, entries in owned]
        frame = local_rows(spark, rows, MANIFEST_SCHEMA).coalesce(1)
        frame.write.mode("overwrite").options(**DYNAMIC).partitionBy("tier", "grain", "period").parquet(manifest_path(root))
