"""Reading raw JSONL chunks: verbatim, tolerant or typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk names: YYYY-MM-DD/HH-MM-SS-host-pid-id.jsonl below any root.  A rewritten
# chunk is a folder of that name (log_day=.../chunk=...) with parts.
_CHUNK = r"\d{4}-\d{2}-\d{2}/(?:\d{2}-[^/]*|chunk=\d{2}-[^/]*/[^/]*)$"


def _below_root(path: Column) -> Column:
    """The path from its day on, '' where it is no chunk's: the one search that a line's day and hour share."""
    return F.regexp_extract(path, _CHUNK, 0)


def chunk_day(path: Column) -> Column:
    return F.substring(_below_root(path), 1, 10).try_cast("date")


def chunk_hour(path: Column) -> Column:
    found = _below_root(path)
    rewritten = F.substring(found, 12, 6) == "chunk="
    return F.nullif(F.when(rewritten, F.substring(found, 18, 2)).otherwise(F.substring(found, 12, 2)), F.lit("")).cast("int")


def with_chunk_name(lines: DataFrame, *more: str) -> DataFrame:
    """Adds path, log_day and log_hour to lines read from files."""
    path = F.col("_metadata.file_path")
    return lines.select(
        F.col("value").alias("entry"), path.alias("path"), chunk_day(path).alias("log_day"), chunk_hour(path).alias("log_hour"),
        *more,
    )


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per non-blank line with the whole object kept as text.

    `position` orders the lines of a chunk: the block of the file, then the row.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    position = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return with_chunk_name(lines.withColumn("position", position).where(F.trim("value") != ""), "position")


def is_document(text: Column) -> Column:
    """Whether a line is exactly one complete JSON document, of any size.

    JSON functions stop after the first value, so a record glued to another one or followed by the
    tail of a torn one would pass.  Wrapped in brackets the line must be one element up to the
    closing bracket, and wrapped in an object one member; no text can close both wrappers early.
    The second test is for lines with a square bracket, without which none can close the first.
    The wrappers are read by a tokenizer that is lenient about quotes; a line that does not open
    like an object of double-quoted keys must pass the strict parser too.
    """
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}")))) == 1
    alone = listed & (~F.contains(text, F.lit("]")) | member)
    strict = text.rlike(r'^\s*\{\s*"') | F.try_parse_json(text).isNotNull()
    return F.coalesce((F.trim(text) != "") & alone & strict, F.lit(False))


def split_malformed(raw: DataFrame, column: str = "entry") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): a broken line is set aside with its path, not lost."""
    return raw.where(is_document(F.col(column))), raw.where(~is_document(F.col(column)))


def read_raw_tolerant(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    return split_malformed(read_raw(spark, *paths))


def read_raw_typed(spark: SparkSession, schema: T.StructType | str, *paths: str) -> DataFrame:
    """Typed columns of chunks whose fields drift; a field a chunk lacks is NULL."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(list(paths))


def hour_glob(root: str, day: str, hour: int) -> str:
    """Path pattern of one hour's chunks, so that no other file is listed or read."""
    return f"{root.rstrip('/')}/{day}/{hour:02d}-*"


def in_hour(raw: DataFrame, day: str, hour: int) -> DataFrame:
    """Lines of one hour by chunk name, where the root is read as a whole."""
    return raw.where((F.col("log_day") == F.to_date(F.lit(day))) & (F.col("log_hour") == hour))
