"""Structured Streaming forms of the flattening, balance, pairing and dictionary operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.compat import blank_to_null, spread_nulls
from logloom.functions.scrub import scrub_text
from logloom.operators.capture import prompt_hash
from logloom.operators.flatten import flatten_entries
from logloom.operators.stats import balance_columns, count_by_type
from logloom.schemas import WIDE_COLUMNS
from logloom.sources import chunk_index as ci
from logloom.sources.raw import is_document, split_malformed, with_chunk_name
from logloom.sources.tiers import DAY, grain_path, rewrite_in_place

# Fixed values of the log writers: flush interval and upstream budget.
FLUSH = "60 seconds"
UPSTREAM_BUDGET = "20 minutes"


def raw_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """(entry) rows of JSONL chunks as they arrive."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).where(F.trim("value") != "").select(F.col("value").alias("entry"))


def entry_stream(raw: DataFrame) -> DataFrame:
    """Wide rows of a raw stream."""
    return flatten_entries(raw)


def append_chunks(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, **options: str) -> StreamingQuery:
    """Appends a stream to Parquet, one batch per flush interval or all that is there.

    The sink's commit log makes a retried batch replace itself; file names never
    collide.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    for key, value in options.items():
        writer = writer.option(key, value)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def stream_consolidate(spark: SparkSession, source: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Raw chunks to a consolidated table of its own, continuously, partitioned by record day.

    A broken line is left out here, as the batch form does; `stream_quarantine`
    keeps it with its chunk.  The sink keeps a log of its files and hides all others, so this
    table is the stream's alone; `stream_to_lake` shares the tier of the batch jobs.
    """
    good, _ = split_malformed(raw_stream(spark, source))
    wide = entry_stream(good).withColumn("log_date", F.to_date("ts"))
    writer = wide.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.option("compression", "zstd").partitionBy("log_date")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(target)


def stream_to_lake(
    spark: SparkSession, source: str, root: str, checkpoint: str, name: str = "live", every: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Raw chunks to the lake's consolidated tier, continuously, beside the batch jobs.

    Rows are filed by chunk day, as `plans.jobs.consolidate` files them.  The chunk index is the ledger:
    a chunk that a batch job or an earlier batch of the stream has brought adds nothing, and a batch
    run that replaces a day takes over what the stream has written of it.  A repeated batch finds
    its own files by their names and replaces them.  Broken lines are counted in the index;
    `stream_quarantine` keeps them.  Turns and sessions follow by `plans.jobs.rebuild_pending`, which
    sees in the index which periods have new records.  A stream and a batch job run one at a time.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_chunk_name(reader.text(source).where(F.trim("value") != "")).withColumnRenamed("log_day", DAY)

    def add(batch: DataFrame, number: int) -> None:
        add_chunks(batch, root, f"stream-{name}-{number}")

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def add_chunks(lines: DataFrame, root: str, writer: str) -> None:
    """Adds the lines (entry, path, log_date) of chunks that the lake does not hold yet, as files of `writer`.

    The rows are complete, aside, before the first file is published; files left by an earlier
    attempt of the same writer go first, and the index is written last.
    """
    spark = lines.sparkSession
    there = ci.read_index(spark, root).where(F.col("writer") != writer).select("path").distinct()
    fresh = lines.join(there, "path", "left_anti").withColumn("__good", is_document(F.col("entry")))
    aside = f"{root.rstrip('/')}/incoming/{writer}"
    parsed = flatten_entries(fresh.select("entry", "path", DAY, "__good")).select(*WIDE_COLUMNS, "path", "__good", DAY)
    parsed.write.mode("overwrite").parquet(f"{aside}/parsed")
    stored = spark.read.parquet(f"{aside}/parsed")
    good = stored.where("__good").select(*WIDE_COLUMNS, DAY)
    good.repartition(DAY).sortWithinPartitions(DAY, "ts").write.mode("overwrite").option("compression", "zstd").partitionBy(DAY).parquet(f"{aside}/files")
    tier = grain_path(root, "consolidated", "day")
    for day in ci.distinct_days(lines, DAY):
        folder, here = ci.folder_of(day), f"{aside}/files/{ci.folder_of(day)}"
        for old in ci.names_in(spark, f"{tier}/{folder}"):
            if old.startswith(f"{writer}-"):
                ci.remove(spark, f"{tier}/{folder}/{old}")
        parts = [n for n in ci.names_in(spark, here) if n.endswith(".parquet")]
        for i, part in enumerate(parts):
            ci.move(spark, f"{here}/{part}", f"{tier}/{folder}/{writer}-{i}.parquet")
    spark.catalog.refreshByPath(tier)
    ci.write_index(ci.index_rows(stored, F.col("__good")), root, writer)
    ci.remove(spark, aside)


def stream_quarantine(spark: SparkSession, source: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The broken lines of raw chunks, with the chunk they came from."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(source).where(F.trim("value") != "")
    return append_chunks(split_malformed(with_chunk_name(lines))[1], target, checkpoint, every)


def stream_balance(entries: DataFrame, width: str = FLUSH, lateness: str = "10 minutes", min_requests: int = 20, floor: float = 0.5) -> DataFrame:
    """Log balance per window, given out once the watermark has passed the window."""
    return count_by_type(entries.withWatermark("ts", lateness), width).select("*", *balance_columns(min_requests, floor))


def stream_pair(entries: DataFrame, lateness: str = "10 minutes", budget: str = UPSTREAM_BUDGET) -> DataFrame:
    """Requests with their response, or alone once the upstream budget has run out.

    State is bounded by the watermark on both sides and the budget.  Requests without an id match
    nothing; they are spread over the state partitions, and responses without one keep no state.
    """
    requests = entries.where(F.col("type") == "request").select(
        "request_id", F.col("ts").alias("request_ts"), "session_id", "model", spread_nulls("request_id", "ts", "session_id").alias("__key")
    ).withWatermark("request_ts", lateness)
    responses = entries.where((F.col("type") == "response") & F.col("request_id").isNotNull()).select(
        F.col("request_id").alias("__rid"), F.col("ts").alias("response_ts"), "latency_ms", "error"
    ).withWatermark("response_ts", lateness)
    on = (
        (F.col("__key") == F.col("__rid"))
        & (F.col("response_ts") >= F.col("request_ts"))
        & (F.col("response_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {budget}"))
    )
    outcome = F.when(F.col("response_ts").isNull(), "incomplete").when(
        blank_to_null(F.col("error")).isNotNull(), "error"
    ).otherwise("ok")
    return requests.join(responses, on, "left_outer").drop("__rid", "__key").withColumn("outcome", outcome)


PROMPTS = "system_sha256 string, content string"
RANGE = "hash_range"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary that `stream_prompts` keeps: hash and scrubbed prompt, one row per prompt."""
    return spark.read.schema(f"{PROMPTS}, {RANGE} string").parquet(path).drop(RANGE)


def hash_range(digest: Column, digits: int = 2) -> Column:
    """Folder of a hash: its first hexadecimal digits, after a letter that keeps the value a text."""
    return F.concat(F.lit("h"), F.left(digest, F.lit(digits)))


def stream_prompts(
    messages: DataFrame, path: str, checkpoint: str, every: str | None = None, digits: int = 2
) -> StreamingQuery:
    """Appends every system prompt to a dictionary table at its first sight.

    `messages` is (role, content, ...).  One prompt may come with most requests,
    so a batch is first reduced by an aggregate that combines before the
    shuffle; only its distinct prompts, written aside, meet the table.  The dictionary is stored by
    hash range (16 to the power of `digits` folders).  A batch reads the hashes of the ranges that its
    own prompts fall into; one without new prompts writes nothing.  A repeated batch finds its prompts
    there already and adds nothing.  `compact_prompts` merges the files of many batches.
    Credentials are removed before a prompt is stored; the hash is that of the prompt as it was sent.
    """
    spark = messages.sparkSession
    if not 1 <= digits <= 3:
        raise ValueError(f"digits must be 1 to 3, not {digits}")
    prompts = messages.where((F.col("role") == "system") & F.col("content").isNotNull()).select(
        prompt_hash(F.col("content")).alias("system_sha256"), "content"
    )
    stored = f"{PROMPTS}, {RANGE} string"
    spark.createDataFrame([], stored).write.mode("append").partitionBy(RANGE).parquet(path)
    aside = f"{checkpoint.rstrip('/')}-incoming"

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        sent = batch.groupBy("system_sha256").agg(F.min("content").alias("content"))
        sent.withColumn(RANGE, hash_range(F.col("system_sha256"), digits)).write.mode("overwrite").parquet(aside)
        sent = session.read.schema(stored).parquet(aside)
        touched = [r[0] for r in sent.select(RANGE).distinct().collect()]  # no more than there are folders
        if touched:
            session.catalog.refreshByPath(path)
            known = session.read.schema(stored).parquet(path).where(F.col(RANGE).isin(touched)).select("system_sha256")
            fresh = sent.join(known, "system_sha256", "left_anti").withColumn("content", scrub_text(F.col("content")))
            if not fresh.isEmpty():
                fresh.repartition(RANGE).write.mode("append").partitionBy(RANGE).parquet(path)
        ci.remove(session, aside)

    writer = prompts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def compact_prompts(spark: SparkSession, path: str) -> int:
    """Rewrites the dictionary in the order of its hashes, few files a range; returns its rows.  Not beside a running stream."""
    if not any(n.startswith(f"{RANGE}=") for n in ci.names_in(spark, path)):
        return 0
    return rewrite_in_place(spark, path, lambda df: df, partition=RANGE, order="system_sha256")
