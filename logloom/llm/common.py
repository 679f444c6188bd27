"""What the corpus operators share: reading tables, staging results, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import shared_dir

# The white space that ends a word, as a Java and RE2 character class.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def string_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
