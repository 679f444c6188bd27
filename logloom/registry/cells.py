"""Queries over cell-keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.functions.compat import rounded
from logloom.operators import cells
from logloom.registry.base import query, with_ctes, written_once
from logloom.sources.cell_tables import read_cells, write_cells

CELLS, MASK, EVEN, ZONES = (
    f"cells AS ({fx.CELLS})", f"mask AS ({fx.MASK})", f"even AS ({fx.MASK_EVEN})", f"zones AS ({fx.ZONES})",
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, fx.CELLS, "lineitem")


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, fx.MASK, "part")


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, fx.MASK_EVEN, "part")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, fx.ZONES, "part")


def _to(digits: int, df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


# The year is part of the question asked.
@query(
    "masked_aggregate",
    with_ctes(CELLS, MASK, body="SELECT klass, round(sum(value), 2) AS total FROM cells SEMI JOIN mask USING (h0, cell) WHERE yr = 1998 GROUP BY klass"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = _cells(spark, sf_dir).where(F.col("yr") == 1998)
    return _to(2, cells.masked_sum(year, _mask(spark, sf_dir), ["h0", "cell"], "klass"), "total")


@query("mask_difference", with_ctes(MASK, EVEN, body="SELECT DISTINCT h0, cell FROM mask ANTI JOIN even USING (cell)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.mask_difference(_mask(spark, sf_dir), _even(spark, sf_dir), "cell")


@query(
    "masked_difference_aggregate",
    with_ctes(
        CELLS, MASK, EVEN, "hs AS (SELECT DISTINCT h0, cell FROM mask ANTI JOIN even USING (cell))",
        body="SELECT klass, round(sum(value), 2) AS total FROM cells SEMI JOIN hs USING (h0, cell) GROUP BY klass",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = cells.mask_difference(_mask(spark, sf_dir), _even(spark, sf_dir), "cell")
    return _to(2, cells.masked_sum(_cells(spark, sf_dir), high, ["h0", "cell"], "klass"), "total")


@query("cell_join", with_ctes(CELLS, ZONES, body="SELECT zone, round(sum(value), 2) AS total FROM cells JOIN zones USING (h0, cell) GROUP BY zone"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to(2, cells.cell_join(_cells(spark, sf_dir), _zones(spark, sf_dir)), "total")


def _stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_cells(spark, written_once(spark, sf_dir, "cells-by-h0", lambda path: write_cells(_cells(spark, sf_dir), path)))


@query(
    "cell_join_stored",
    with_ctes(CELLS, ZONES, body="SELECT zone, round(sum(value), 2) AS total FROM cells JOIN zones USING (h0, cell) WHERE size >= 49 GROUP BY zone"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join on cells stored by h0: the zones' filter prunes the folders that are read."""
    return _to(2, cells.cell_join(_stored_cells(spark, sf_dir), _zones(spark, sf_dir).where("size >= 49")), "total")


@query(
    "region_subset",
    with_ctes(
        CELLS, ZONES, "region AS (SELECT h0, cell FROM zones WHERE zone = 'Brand#7')",
        body="""SELECT round(sum(value), 2) AS total, count(*) AS cell_rows FROM cells
          WHERE h0 IN (SELECT h0 FROM region) AND cell IN (SELECT cell FROM region)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _zones(spark, sf_dir).where(F.col("zone") == "Brand#7")
    inside = cells.region_subset(_cells(spark, sf_dir), region)
    return inside.agg(rounded(F.sum("value"), 2).alias("total"), F.count("*").alias("cell_rows"))


_PARENTS = (
    "coarse AS (SELECT parent, avg(size) AS v FROM zones GROUP BY parent)",
    "touched AS (SELECT DISTINCT c.fid, z.parent FROM cells c JOIN zones z USING (h0, cell))",
)


def _parent_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _zones(spark, sf_dir)
    coarse = zones.groupBy("parent").agg(F.avg("size").alias("v"))
    placed = _cells(spark, sf_dir).join(zones.select("h0", "cell", "parent"), ["h0", "cell"])
    return cells.parent_mean(coarse, placed, "parent", "fid", "v")


@query(
    "parent_join",
    with_ctes(CELLS, ZONES, *_PARENTS, body="SELECT fid, round(avg(v), 6) AS mean_value, count(*) AS cells FROM touched JOIN coarse USING (parent) GROUP BY fid"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to(6, _parent_means(spark, sf_dir), "mean_value")


# Support is counted in parents per brand, so that some brands fall short.
MIN_PARENTS = 76


@query(
    "mean_min_support",
    with_ctes(
        ZONES,
        f"brand AS (SELECT zone, avg(size) AS mean_value, count(*) AS cells FROM (SELECT DISTINCT zone, parent, size FROM zones) t GROUP BY zone HAVING count(*) >= {MIN_PARENTS})",
        body="SELECT zone, round(mean_value, 6) AS mean_value, cells FROM brand ORDER BY mean_value DESC, zone LIMIT 5",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _zones(spark, sf_dir).select("zone", "parent", "size").distinct()
    means = sizes.groupBy("zone").agg(F.avg("size").alias("mean_value"), F.count("*").alias("cells"))
    top = cells.top_k(cells.with_min_support(_to(6, means, "mean_value"), MIN_PARENTS), "mean_value", 5, "zone")
    return top


@query(
    "attribute_join",
    with_ctes(
        CELLS, MASK,
        "present AS (SELECT DISTINCT fid FROM cells SEMI JOIN mask USING (h0, cell))",
        body="SELECT round(sum(s_acctbal), 2) AS total, count(*) AS features FROM present JOIN supplier ON s_suppkey = fid",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), "s_acctbal")
    return _to(2, cells.attribute_sum(_cells(spark, sf_dir), suppliers, "fid", "s_acctbal", _mask(spark, sf_dir), ["h0", "cell"]), "total")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_acctbal").alias("amount"))


@query(
    "full_overlap",
    with_ctes(
        CELLS, ZONES, "pairs AS (SELECT DISTINCT zone, fid FROM cells JOIN zones USING (h0, cell))",
        body="SELECT zone, round(sum(s_acctbal), 2) AS total, count(*) AS features FROM pairs JOIN supplier ON s_suppkey = fid GROUP BY zone",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cells.full_overlap(_cells(spark, sf_dir), _zones(spark, sf_dir), _amounts(spark, sf_dir), "fid", ["h0", "cell"])
    return _to(2, got, "total")


@query(
    "apportioned",
    with_ctes(
        CELLS, ZONES, "fc AS (SELECT DISTINCT fid, h0, cell FROM cells)",
        "n AS (SELECT fid, zone, count(*) AS n FROM fc JOIN zones USING (h0, cell) GROUP BY fid, zone)",
        "w AS (SELECT *, sum(n) OVER (PARTITION BY fid) AS all_cells FROM n)",
        body="SELECT zone, round(sum(s_acctbal * n / all_cells), 2) AS total FROM w JOIN supplier ON s_suppkey = fid GROUP BY zone",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cells.apportioned(_cells(spark, sf_dir), _zones(spark, sf_dir), _amounts(spark, sf_dir), "fid", ["h0", "cell"])
    return _to(2, got, "total")


@query(
    "share_of_total",
    with_ctes(
        ZONES, MASK,
        body="""SELECT (SELECT count(DISTINCT cell) FROM zones WHERE cell IN (SELECT cell FROM mask)) AS covered, count(DISTINCT cell) AS total,
          round(100.0 * (SELECT count(DISTINCT cell) FROM zones WHERE cell IN (SELECT cell FROM mask)) / count(DISTINCT cell), 6) AS pct FROM zones""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to(6, cells.share_of_total(_zones(spark, sf_dir), _mask(spark, sf_dir)), "pct")


@query(
    "ratio_of_sums",
    with_ctes(
        CELLS,
        body="""SELECT round(sum(value), 2) AS numerator, (SELECT round(sum(o_totalprice), 2) FROM orders) AS denominator,
          round(100 * sum(value) / (SELECT sum(o_totalprice) FROM orders), 6) AS pct FROM cells""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cells.ratio_of_sums(_cells(spark, sf_dir), "value", fx.table(spark, sf_dir, "orders"), "o_totalprice")
    return _to(6, _to(2, got, "numerator", "denominator"), "pct")


@query(
    "group_share",
    with_ctes(
        ZONES,
        "low AS (SELECT cell FROM zones WHERE size = 50)",
        "s AS (SELECT zone, avg(CASE WHEN cell IN (SELECT cell FROM low) THEN 1.0::double ELSE 0.0::double END) AS share, count(*) AS cells FROM zones GROUP BY zone HAVING count(*) >= 50)",
        body="SELECT zone, round(share, 9) AS share, cells, rank() OVER (ORDER BY share) AS rank_low FROM s",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _zones(spark, sf_dir).where(F.col("size") == 50)
    return _to(9, cells.group_share(_zones(spark, sf_dir), low), "share")


_FEATURES = "fc AS (SELECT h0, cell, fid, round(value / 100) AS part, CASE WHEN fid % 7 = 0 THEN 0 ELSE 1100.0::double END AS whole FROM cells)"
_WEIGHTS = "cw AS (SELECT h0, cell, max(CASE WHEN whole > 0 THEN part / whole ELSE 0 END) AS weight FROM (SELECT DISTINCT * FROM fc) d GROUP BY h0, cell)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("fid") % 7 == 0, 0.0).otherwise(1100.0)
    return _cells(spark, sf_dir).select("h0", "cell", "fid", rounded(F.col("value") / 100).alias("part"), whole.alias("whole"))


@query(
    "weighted_overlay",
    with_ctes(
        CELLS, MASK, _FEATURES, _WEIGHTS,
        body="""SELECT klass, round(sum(frac) * 3.5, 4) AS total, round(sum(frac * coalesce(weight, 0)) * 3.5, 4) AS covered,
          round(100 * sum(frac * coalesce(weight, 0)) / sum(frac), 6) AS pct
          FROM cells LEFT JOIN (SELECT * FROM cw SEMI JOIN mask USING (h0, cell)) w USING (h0, cell) GROUP BY klass""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    protected = cells.masked(_features(spark, sf_dir), _mask(spark, sf_dir), ["h0", "cell"])
    weights = cells.cell_weight(protected, "part", "whole", "fid", ["h0", "cell"])
    got = cells.weighted_overlay(_cells(spark, sf_dir), weights, ["h0", "cell"], "klass", unit=3.5)
    return _to(6, _to(4, got, "total", "covered"), "pct")


@query(
    "quantile_share",
    with_ctes(
        CELLS, _FEATURES, _WEIGHTS,
        "thr AS (SELECT quantile_cont(p_retailprice, 0.8) AS t FROM (SELECT DISTINCT p_partkey, p_retailprice FROM part) d)",
        body="""SELECT round(100 * sum(CASE WHEN p_retailprice >= (SELECT t FROM thr) THEN weight ELSE 0 END) / sum(weight), 6) AS pct, (SELECT round(t, 6) FROM thr) AS threshold
          FROM cw JOIN part ON p_partkey = cell""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), "p_retailprice")
    weights = cells.cell_weight(_features(spark, sf_dir), "part", "whole", "fid", ["h0", "cell"]).join(part, "cell")
    return _to(6, cells.quantile_share(part, "cell", "p_retailprice", weights), "pct", "threshold")


@query(
    "minmax_composite",
    """WITH g AS (SELECT p_brand AS basin, cast(sum(p_size) AS bigint) AS extent, count(*) AS parts, max(p_size) AS intensity, 1 AS constant FROM part GROUP BY 1),
      b AS (SELECT min(extent) AS e0, max(extent) AS e1, min(parts) AS c0, max(parts) AS c1, min(intensity) AS i0, max(intensity) AS i1 FROM g),
      s AS (SELECT g.*, round((coalesce((extent - e0) / nullif(cast(e1 - e0 AS double), 0), 0) + coalesce((parts - c0) / nullif(cast(c1 - c0 AS double), 0), 0)
        + coalesce((intensity - i0) / nullif(cast(i1 - i0 AS double), 0), 0) + 0) / 4, 9) AS composite FROM g, b)
      SELECT basin, extent, parts, intensity, composite, rank() OVER (ORDER BY composite DESC) AS rank FROM s""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    basins = part.groupBy(F.col("p_brand").alias("basin")).agg(
        F.sum("p_size").alias("extent"), F.count("*").alias("parts"), F.max("p_size").alias("intensity"), F.lit(1).alias("constant")
    )
    return cells.minmax_composite(basins, ["extent", "parts", "intensity", "constant"]).drop("constant")


@query(
    "dominant_class",
    with_ctes(
        CELLS, "n AS (SELECT cell, klass, count(*) AS n FROM cells GROUP BY cell, klass)",
        body="SELECT cell, klass, n FROM n QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, klass) = 1",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.dominant_class(_cells(spark, sf_dir), "cell", "klass")


@query(
    "top_class",
    with_ctes(
        CELLS, ZONES, "n AS (SELECT klass, zone, count(*) AS n FROM cells JOIN zones USING (h0, cell) GROUP BY 1, 2)",
        body="SELECT klass, zone, n FROM n QUALIFY row_number() OVER (PARTITION BY klass ORDER BY n DESC, zone) = 1",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _cells(spark, sf_dir).join(_zones(spark, sf_dir).select("h0", "cell", "zone"), ["h0", "cell"])
    return cells.top_per_class(placed, "klass", "zone")


@query(
    "count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS entities, count(*) AS row_count FROM lineitem GROUP BY 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.count_distinct_by(fx.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey")


@query(
    "conditional_counts",
    "SELECT count(*) FILTER (WHERE flag) AS flagged, count(*) AS total FROM (SELECT DISTINCT l_suppkey, l_discount > 0.09 AS flag FROM lineitem) d",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.conditional_counts(fx.table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_discount") > 0.09)


_MEASURES = """measures AS (SELECT c_nationkey AS zone, o_custkey AS id, o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS reach,
  cast(strftime(o_orderdate, '%Y') AS integer) AS yr FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("zone"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reach"), F.year("o_orderdate").alias("yr"),
    )


# Status and years are part of the question asked: measures that passed since a year.
@query(
    "separated_totals",
    with_ctes(
        _MEASURES,
        """t AS (SELECT zone, round(sum(amount), 2) AS total, round(coalesce(sum(amount) FILTER (WHERE reach = '1-URGENT'), 0), 2) AS wide_total,
             round(coalesce(sum(amount) FILTER (WHERE reach <> '1-URGENT'), 0), 2) AS local_total FROM measures WHERE status = 'F' AND yr >= 1995 GROUP BY zone)""",
        body="SELECT *, rank() OVER (ORDER BY local_total DESC) AS local_rank FROM t",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = _measures(spark, sf_dir).where((F.col("status") == "F") & (F.col("yr") >= 1995))
    return cells.separated_totals(passed, "zone", F.col("reach") == "1-URGENT", "amount")


@query(
    "deduped_sum",
    with_ctes(
        _MEASURES, "o AS (SELECT zone, id, max(c_acctbal) AS a FROM measures JOIN customer ON c_custkey = id WHERE status IN ('F', 'P') AND yr >= 1996 GROUP BY 1, 2)",
        body="SELECT zone, round(sum(a), 2) AS total, count(*) AS entities FROM o GROUP BY zone",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One balance per customer however many orders repeat it."""
    orders, customer = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    kept = orders.where(F.col("o_orderstatus").isin("F", "P") & (F.year("o_orderdate") >= 1996))
    rows = kept.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("zone"), "c_custkey", "c_acctbal")
    return _to(2, cells.deduped_sum(rows, "zone", "c_custkey", "c_acctbal"), "total")


@query(
    "peak_periods",
    with_ctes(
        CELLS, "n AS (SELECT yr, count(*) AS n FROM cells GROUP BY yr)",
        body="SELECT yr, n, rank() OVER (ORDER BY n DESC) AS peak_rank, rank() OVER (ORDER BY n) AS lull_rank FROM n",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.peak_periods(_cells(spark, sf_dir), "yr")


@query(
    "top_k",
    with_ctes(CELLS, ZONES, body="SELECT zone, round(sum(value), 2) AS total FROM cells JOIN zones USING (h0, cell) GROUP BY zone ORDER BY total DESC, zone LIMIT 10"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.top_k(_to(2, cells.cell_join(_cells(spark, sf_dir), _zones(spark, sf_dir)), "total"), "total", 10, "zone")


@query(
    "top_k_entities",
    "SELECT c_nationkey, count(DISTINCT o_custkey) AS entities, count(*) AS row_count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY entities DESC, c_nationkey LIMIT 12",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    return cells.top_k(cells.count_distinct_by(rows, "c_nationkey", "o_custkey"), "entities", 12, "c_nationkey")
