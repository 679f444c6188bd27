"""Masked, weighted and normalised aggregates over cell-keyed tables.

A cell table has a coarse partition id `h0` and a fine cell id.  Joins use both
so that partitions prune; `h0` alone is never a boundary.  Masks are joined as
semi joins before anything is aggregated, so repeated cells in a mask cannot
multiply values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import count_if, ratio, rounded
from logloom.operators.ordering import exact_percentile, rank_descending


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def masked(values: DataFrame, mask: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of `values` whose cell is in the mask."""
    return values.join(mask.select(*_keys(on)), _keys(on), "left_semi")


def mask_difference(mask: DataFrame, minus: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Distinct cells of one mask that are not in another."""
    return mask.join(minus.select(*_keys(on)), _keys(on), "left_anti").distinct()


def masked_sum(values: DataFrame, mask: DataFrame, on: str | Sequence[str], by: str, value: str = "value") -> DataFrame:
    return masked(values, mask, on).groupBy(by).agg(F.sum(value).alias("total"))


def cell_join(values: DataFrame, zones: DataFrame, on: Sequence[str] = ("h0", "cell"), by: str = "zone", value: str = "value") -> DataFrame:
    """Total per zone of the values on its cells."""
    return values.join(zones.select(*on, by), list(on)).groupBy(by).agg(F.sum(value).alias("total"))


def region_subset(values: DataFrame, region: DataFrame, cell: str = "cell", part: str = "h0") -> DataFrame:
    """Values clipped to a region; the partition id only prunes, the cell decides."""
    return masked(values, region, [part, cell])


def parent_mean(children: DataFrame, features: DataFrame, parent: str, feature: str, value: str) -> DataFrame:
    """Mean of a coarse value per feature: fine cells are rolled up to parents once, then joined.

    `features` is (feature, parent) in fine-cell rows; `children` is (parent, value).
    """
    touched = features.select(feature, parent).distinct()
    return touched.join(children.select(parent, value), parent).groupBy(feature).agg(
        F.avg(value).alias("mean_value"), F.count("*").alias("cells")
    )


def with_min_support(means: DataFrame, least: int = 3) -> DataFrame:
    """Drops features seen on too few cells, whose mean is an artefact."""
    return means.where(F.col("cells") >= least)


def attribute_sum(cells: DataFrame, features: DataFrame, fid: str, attribute: str, mask: DataFrame | None = None, on: str | Sequence[str] = "cell") -> DataFrame:
    """Sum of a feature attribute over the features present, each counted once."""
    present = (masked(cells, mask, on) if mask is not None else cells).select(fid).distinct()
    return present.join(features.select(fid, attribute), fid).agg(
        F.sum(attribute).alias("total"), F.count("*").alias("features")
    )


def full_overlap(feature_cells: DataFrame, zones: DataFrame, amounts: DataFrame, fid: str, on: str | Sequence[str], zone: str = "zone", amount: str = "amount") -> DataFrame:
    """Per zone the full amount of every feature that touches it."""
    pairs = feature_cells.select(fid, *_keys(on)).join(zones.select(*_keys(on), zone), _keys(on)).select(zone, fid).distinct()
    return pairs.join(amounts.select(fid, amount), fid).groupBy(zone).agg(
        F.sum(amount).alias("total"), F.count("*").alias("features")
    )


def apportioned(feature_cells: DataFrame, zones: DataFrame, amounts: DataFrame, fid: str, on: str | Sequence[str], zone: str = "zone", amount: str = "amount") -> DataFrame:
    """Per zone each feature's amount in proportion to its cells there."""
    placed = feature_cells.select(fid, *_keys(on)).distinct().join(zones.select(*_keys(on), zone), _keys(on))
    per_pair = placed.groupBy(fid, zone).agg(F.count("*").alias("n"))
    whole = per_pair.groupBy(fid).agg(F.sum("n").alias("all_cells"))
    return (
        per_pair.join(whole, fid)
        .join(amounts.select(fid, amount), fid)
        .groupBy(zone)
        .agg(F.sum(F.col(amount) * F.col("n") / F.col("all_cells")).alias("total"))
    )


def share_of_total(all_cells: DataFrame, mask: DataFrame, cell: str = "cell") -> DataFrame:
    """Percent of distinct cells covered by a mask, with both counts."""
    flagged = all_cells.select(cell).distinct().join(
        mask.select(F.col(cell)).distinct().withColumn("hit", F.lit(1)), cell, "left"
    )
    covered = F.count("hit")
    return flagged.agg(
        covered.alias("covered"), F.count("*").alias("total"), (100.0 * ratio(covered, F.count("*"))).alias("pct")
    )


def ratio_of_sums(part: DataFrame, part_value: str, whole: DataFrame, whole_value: str, scale: float = 100.0) -> DataFrame:
    """Sum of one table over the sum of another, independent one."""
    denominator = whole.agg(F.sum(whole_value).alias("d")).scalar()
    return part.agg(F.sum(part_value).alias("numerator")).select(
        "numerator", denominator.alias("denominator"), (F.lit(scale) * ratio(F.col("numerator"), denominator)).alias("pct")
    )


def group_share(zones: DataFrame, mask: DataFrame, cell: str = "cell", zone: str = "zone", least: int = 50) -> DataFrame:
    """Per zone the share of its cells in the mask and its rank from the lowest; ties share a rank."""
    flags = zones.select(zone, cell).distinct().join(
        mask.select(cell).distinct().withColumn("hit", F.lit(1.0)), cell, "left"
    )
    shares = (
        flags.groupBy(zone)
        .agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"), F.count("*").alias("cells"))
        .where(F.col("cells") >= least)
    )
    return rank_descending(shares.withColumn("__neg", -F.col("share")), "__neg", "rank_low").drop("__neg")


def cell_weight(feature_cells: DataFrame, part: str, whole: str, fid: str, cell: Sequence[str]) -> DataFrame:
    """Per cell the greatest part/whole of the distinct features on it; 0 where whole is 0."""
    weight = F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return feature_cells.select(*cell, fid, part, whole).distinct().groupBy(*cell).agg(F.max(weight).alias("weight"))


def weighted_overlay(fractions: DataFrame, weights: DataFrame, cell: Sequence[str], klass: str, frac: str = "frac", unit: float = 1.0) -> DataFrame:
    """Per class: total area, covered area and percent; cells without weight count 0."""
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    covered, total = F.sum(F.col(frac) * w), F.sum(frac)
    return (
        fractions.join(weights, list(cell), "left")
        .groupBy(klass)
        .agg((total * unit).alias("total"), (covered * unit).alias("covered"), (100.0 * ratio(covered, total)).alias("pct"))
    )


def quantile_share(population: DataFrame, entity: str, metric: str, cells: DataFrame, weight: str = "weight", p: float = 0.8) -> DataFrame:
    """Percent of weight on cells whose metric reaches the p-quantile of the distinct entities."""
    distinct = population.select(entity, metric).distinct()
    threshold = exact_percentile(distinct, [], metric, p, "t").scalar()
    high = F.when(F.col(metric) >= threshold, F.col(weight)).otherwise(F.lit(0.0))
    return cells.agg((100.0 * ratio(F.sum(high), F.sum(weight))).alias("pct")).withColumn("threshold", threshold)


def minmax_composite(groups: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of the min-max normalised metrics and its rank; a constant metric counts 0.

    The extremes are scalar subqueries, so no window spans the frame.
    """
    def unit(m: str) -> Column:
        low = groups.agg(F.min(m).alias("x")).scalar()
        high = groups.agg(F.max(m).alias("x")).scalar()
        return F.coalesce(F.try_divide(F.col(m).cast("double") - low, (high - low).cast("double")), F.lit(0.0))

    total = sum((unit(m) for m in metrics[1:]), unit(metrics[0]))
    return rank_descending(groups.withColumn("composite", rounded(total / len(metrics), 9)), "composite", "rank")


def dominant_class(cells: DataFrame, cell: str, klass: str) -> DataFrame:
    """Most frequent class per cell; a tie goes to the lowest class."""
    n = cells.groupBy(cell, klass).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(klass).alias("c")))
    return n.groupBy(cell).agg(best.alias("b")).select(cell, F.col("b.c").alias(klass), (-F.col("b.k")).alias("n"))


def top_per_class(cells: DataFrame, klass: str, owner: str) -> DataFrame:
    """For every class, the owner with the most rows; a tie goes to the lowest owner."""
    return dominant_class(cells, klass, owner)


def count_distinct_by(rows: DataFrame, by: str, entity: str, approximate: bool = False) -> DataFrame:
    """Distinct entities per group next to the row count."""
    n = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return rows.groupBy(by).agg(n.alias("entities"), F.count("*").alias("row_count"))


def conditional_counts(rows: DataFrame, entity: str, flag: Column) -> DataFrame:
    """Distinct (entity, flag) pairs: how many are flagged, how many there are."""
    pairs = rows.select(F.col(entity), flag.alias("flag")).distinct()
    return pairs.agg(count_if(F.col("flag")).alias("flagged"), F.count("*").alias("total"))


def deduped_sum(rows: DataFrame, zone: str, entity: str, amount: str) -> DataFrame:
    """Sum per zone with each entity counted once, whatever number of rows it has there."""
    once = rows.groupBy(zone, entity).agg(F.max(amount).alias("a"))
    return once.groupBy(zone).agg(F.sum("a").alias("total"), F.count("*").alias("entities"))


def separated_totals(rows: DataFrame, zone: str, wide: Column, amount: str) -> DataFrame:
    """Totals per zone with the part common to all zones apart; rank on the local part."""
    t = rows.groupBy(zone).agg(
        rounded(F.sum(amount), 2).alias("total"),
        rounded(F.coalesce(F.sum(F.when(wide, F.col(amount))), F.lit(0.0)), 2).alias("wide_total"),
        rounded(F.coalesce(F.sum(F.when(~wide, F.col(amount))), F.lit(0.0)), 2).alias("local_total"),
    )
    return rank_descending(t, "local_total", "local_rank")


def peak_periods(rows: DataFrame, period: str) -> DataFrame:
    """Rows per period, ranked from both ends; one row per period."""
    n = rows.groupBy(period).agg(F.count("*").alias("n"))
    high = rank_descending(n, "n", "peak_rank")
    return rank_descending(high.withColumn("__neg", -F.col("n")), "__neg", "lull_rank").drop("__neg")


def top_k(rows: DataFrame, metric: str, k: int, tie: str) -> DataFrame:
    return rows.orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc()).limit(k)


