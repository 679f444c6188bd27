"""Benchmark inputs: trials, grades, transcripts, questions, golden answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.compat import strip
from logloom.schemas import GOLDEN_MANIFEST, TRANSCRIPT, TRIAL_SUMMARY

_SUMMARY_FILE = r"([^/]+)\.summary\.tsv(?:/[^/]*)?$"
_TRANSCRIPT_FILE = r"(q\d+)__([^/]+)__t(\d+)\.json(?:/[^/]*)?$"  # a file, or a folder with its parts


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial summaries of all apps; the app is the name before `.summary.tsv`, of a file or a folder with its parts."""
    df = spark.read.schema(TRIAL_SUMMARY).option("sep", "\t").option("header", "true").option("recursiveFileLookup", "true").csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), _SUMMARY_FILE, 1).alias("app"), *df.columns)


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """Grades by session and cell: session_id, app, q_idx, model, status, score."""
    schema = "session_id string, app string, q_idx string, model string, status string, score double"
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def read_raw_grades(spark: SparkSession, path: str) -> DataFrame:
    """Grades by the first 8 characters of the session id, space separated."""
    return spark.read.schema("prefix string, score double").option("sep", " ").csv(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One run per file; question index, model and trial also from `qN__model__tK.json`."""
    df = spark.read.schema(TRANSCRIPT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    name = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(name, _TRANSCRIPT_FILE, 1).alias("q_idx"),
        F.regexp_extract(name, _TRANSCRIPT_FILE, 2).alias("file_model"),
        F.regexp_extract(name, _TRANSCRIPT_FILE, 3).cast("int").alias("file_trial"),
        *df.columns,
    )


def number_questions(files: DataFrame) -> DataFrame:
    """(app, q_idx, question) from (app, text): blanks and # lines dropped, counted from 1.

    The count is the position in the file's own line array, so no window is needed.
    """
    lines = F.transform(F.split("text", "\n"), strip)
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    return files.select("app", F.posexplode(kept).alias("pos", "question")).select(
        "app", (F.col("pos") + 1).alias("q_idx"), "question"
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    app = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return number_questions(files.select(app.alias("app"), F.col("value").alias("text")))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Question rows of the golden manifest; `accuracy` is NULL for ungraded additions."""
    df = spark.read.schema(GOLDEN_MANIFEST).option("multiLine", "true").json(path)
    return df.select(F.inline("questions")).withColumnRenamed("bench_mean_acc", "accuracy")
