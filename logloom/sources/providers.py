"""Provider configuration and metric samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schemas import PROVIDER_CONFIG
from logloom.sources.chunk_index import entries_in, local_rows

# Schemes that Hadoop has names of its own for.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """One row per provider in declared order: position, models, prefixes, thinking keys, is_default.

    A provider that declares no prefixes uses its model list as prefixes too.
    A default that is not configured is no default.
    """
    df = spark.read.schema(PROVIDER_CONFIG).option("multiLine", "true").json(path)
    empty = F.array().cast("array<string>")
    named = df.select("default_provider", F.posexplode(F.map_entries("providers")).alias("position", "e"))
    cfg = F.col("e.value")
    return named.select(
        F.col("e.key").alias("provider"),
        "position",
        F.coalesce(cfg["models"], empty).alias("models"),
        F.coalesce(cfg["model_prefixes"], cfg["models"], empty).alias("prefixes"),
        cfg["thinking_models"].alias("thinking_models"),
        F.coalesce(cfg["no_sampling_params"], empty).alias("no_sampling_params"),
        F.coalesce(F.col("e.key") == F.col("default_provider"), F.lit(False)).alias("is_default"),
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Metric samples (model, metric, ts, value) kept as Parquet."""
    return spark.read.parquet(path).select("model", "metric", "ts", F.col("value").cast("double").alias("value"))


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Listing of a folder tree (path, length, mtime) without reading the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("mtime"))


def _native(path: str) -> str:
    """A folder as pyarrow names it."""
    scheme, mark, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else path


def list_prefixes(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """The listing of `list_objects`, made by the tasks: the driver knows the folders of the first levels only.

    The folders `depth` levels down (1: the days of the raw chunks) are dealt to tasks, each of which
    lists what lies below its folders and hands on its rows in parts.  Files above that level are listed like folders
    of their own.  Names are hidden as Spark hides them: a leading underscore or dot at any level.
    """
    root, level, files = path.rstrip("/"), [""], []
    for _ in range(depth):
        found = [(f"{at}/{name}", folder) for at in level for name, folder in entries_in(spark, f"{root}{at}") if name[0] not in "_."]
        level = [name for name, folder in found if folder]
        files += [name for name, folder in found if not folder]
    level += files
    tops = local_rows(spark, [(at,) for at in level], "below string")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(_native(root))
        names, kinds = ["path", "length", "mtime"], [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

        def rows(folders: list[str]) -> Iterator[tuple]:
            while folders:
                at = folders.pop()
                info = store.get_file_info(f"{base}{at}")
                if info.is_file:
                    yield f"{root}{at}", info.size, info.mtime
                    continue
                for found in store.get_file_info(fs.FileSelector(f"{base}{at}")):
                    below = f"{at}/{found.base_name}"
                    if found.base_name[0] in "_.":
                        continue
                    if found.is_file:
                        yield f"{root}{below}", found.size, found.mtime
                    else:
                        folders.append(below)

        for batch in batches:
            held: list[tuple] = []
            for row in rows(batch.column(0).to_pylist()):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    tasks = max(1, min(len(level), 4 * spark.sparkContext.defaultParallelism))
    return tops.repartition(tasks).mapInArrow(listed, "path string, length bigint, mtime timestamp")
