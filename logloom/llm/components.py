"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import staged

MAX_ROUNDS = 60


def _toward_minimum(links: DataFrame, both_ways: bool) -> DataFrame:
    """Every neighbour of a node is linked to the least of the node and its neighbours.

    With `both_ways` only larger neighbours move (large star); else the links of a node to
    smaller ones do (small star).  The least is aggregated first, stored, and joined back: as a
    stored table it leaves Spark free to split the links of a node that has very many of them,
    which an aggregate on the join key in the same plan would not.
    """
    if both_ways:
        links = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(links.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
    moved = links.join(least, F.col("a") == F.col("of"))
    if both_ways:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return (
        moved.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        .unionAll(least.select(F.col("of").alias("a"), F.col("least").alias("b"))).distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) of one sortable type: node and component (the least node reachable).

    Nodes without a link to another node do not occur: links with a null end and links of a node to
    itself are left out, repeated and reversed links count once, and an empty table gives no rows.
    Each half round is written to the shared folder; the rounds needed grow with the logarithm of
    the longest chain.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(current)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        larger = staged(_toward_minimum(current, True), "links")
        current = staged(_toward_minimum(larger, False), "links")
        if (now := state(current)) == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
