"""Cell tables stored by their coarse partition id, so that a join with a region reads the region's folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cells(df: DataFrame, path: str, part: str = "h0", cell: str = "cell") -> None:
    """Parquet by coarse id, ordered by cell.

    Rows are range-partitioned by (coarse id, cell): a crowded coarse cell is written by several tasks, each a stretch
    of it, and the order lets a file's row groups be skipped by cell.
    """
    keys = [F.col(part), F.col(cell)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode("errorifexists").option("compression", "zstd").partitionBy(part).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The table as written; a join on the coarse id with a filtered, small side prunes its folders at run time."""
    return spark.read.parquet(path)
