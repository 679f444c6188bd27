"""Positions, running counts and ranks that do not put one group into one task.

A plain window sends all rows of a key to one task.  One session key, function
or model may hold a third of the log, so the rows of a key are first cut into
consecutive buckets (minutes of time, or value ranges).  Rows are numbered
inside a bucket; the sizes of the earlier buckets of the same key are added.
The sizes are one pre-aggregated row per (key, bucket).  The result is the
same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.compat import spread_nulls

_BUCKET = "__bucket"
_BEFORE = "__before"
_FAR_FUTURE = "9999-12-31 00:00:00"


def time_bucket(ts: Column, unit: str = "minute") -> Column:
    """Time range of a row; rows without a time sort last, as one range."""
    cut = F.date_trunc(unit, ts.cast("timestamp"))
    return F.coalesce(cut, F.lit(_FAR_FUTURE).cast("timestamp"))


def _filler(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("1970-01-01").cast(dtype)
    return F.lit(0).cast(dtype)


def _solid_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keys that are never NULL: a nullable one becomes a filled copy and a flag.

    Plain equality on them matches NULL with NULL, and, unlike `<=>`, lets a
    join use the partitioning of the window before it: the wide rows are
    shuffled once.
    """
    solid: list[str] = []
    for i, k in enumerate(keys):
        field = df.schema[k]
        if not field.nullable:
            solid.append(k)
            continue
        df = df.withColumns({
            f"__k{i}": F.coalesce(F.col(k), _filler(field.dataType)), f"__n{i}": F.col(k).isNull()
        })
        solid += [f"__k{i}", f"__n{i}"]
    return df, solid


def _original(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys again, from their filled copies where there are any."""
    out = []
    for i, k in enumerate(keys):
        copied = f"__k{i}" in df.columns
        out.append(F.when(~F.col(f"__n{i}"), F.col(f"__k{i}")).alias(k) if copied else F.col(k))
    return out


def _before(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (key, bucket), the total size of the earlier buckets of the key."""
    window = Window.partitionBy(*keys).orderBy(F.col(_BUCKET).asc()).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(_BEFORE, F.coalesce(F.sum("__size").over(window), F.lit(0)).cast("bigint"))


def next_event(df: DataFrame, events: DataFrame, key: str, ts: str, out: str, unit: str = "hour") -> DataFrame:
    """`df` with the time of the nearest event of the same key at or after its own time.

    `events` is (key, ts) under the same names; `df` may hold other columns.  One row comes out per row
    of `df`, however often a key occurs on either side.  Rows and events of a key are cut into time
    buckets.  A row without an event left in its bucket takes the first event of a later one,
    out of a table of one row per (key, bucket) that holds times only.  A row without a key or
    a time has no event; the ones without a key are spread.
    """
    cut = time_bucket(F.col(ts), unit)
    salt = [c for c, dtype in df.dtypes if c != key and not dtype.startswith(("map", "variant"))]
    rows = df.withColumns({"__key": spread_nulls(key, *salt), _BUCKET: cut, "__row": F.lit(True), "__event": F.lit(None).cast(df.schema[ts].dataType)})
    seen = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("__key"), cut.alias(_BUCKET), F.col(ts).alias("__event")
    )
    firsts = seen.groupBy("__key", _BUCKET).agg(F.min("__event").alias("__first"))
    asked = rows.select("__key", _BUCKET).distinct().withColumn("__first", F.lit(None).cast(df.schema[ts].dataType))
    later = Window.partitionBy("__key").orderBy(F.col(_BUCKET).asc()).rowsBetween(1, Window.unboundedFollowing)
    carried = (
        firsts.unionByName(asked)
        .groupBy("__key", _BUCKET)
        .agg(F.min("__first").alias("__first"))
        .select("__key", _BUCKET, F.min("__first").over(later).alias("__carried"))
    )
    # Events stand before the rows of the same instant when time runs backwards, so these see them.
    both = rows.withColumn("__at", F.col(ts)).unionByName(
        seen.distinct().withColumns({"__at": F.col("__event"), "__row": F.lit(False)}), allowMissingColumns=True
    )
    back = (
        Window.partitionBy("__key", _BUCKET)
        .orderBy(F.col("__at").desc_nulls_last(), F.col("__row").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = both.withColumn("__here", F.last("__event", ignorenulls=True).over(back)).where("__row")
    nearest = F.when(F.col(ts).isNotNull(), F.coalesce("__here", "__carried")).alias(out)
    return found.join(carried, ["__key", _BUCKET], "left").select(*df.columns, nearest)


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """`row_number()` over keys, rows ordered by `order`; `bucket` must follow its first column."""
    solid, ks = _solid_keys(df, keys)
    cut = solid.withColumn(_BUCKET, bucket)
    parts = [*ks, _BUCKET]
    local = cut.withColumn("__pos", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    offsets = _before(cut.groupBy(*parts).agg(F.count("*").alias("__size")), ks).drop("__size")
    return local.join(offsets, parts).select(
        *df.columns, (F.col("__pos") + F.col(_BEFORE)).cast("bigint").alias(name)
    )


def _cuts_below(cuts: Column, value: Column) -> Column:
    """How many cut points are below a value: its place in the sorted cuts, by native array functions."""
    return (F.array_position(F.sort_array(F.array_append(cuts, value)), value) - 1).cast("int")


def rank_descending(df: DataFrame, value: str, name: str, pieces: int = 256) -> DataFrame:
    """`rank()` over the whole frame, highest value first, NULLs last; ties share a rank.

    Equal values are counted first.  One mergeable quantile sketch (a scalar
    subquery of `pieces` numbers) cuts the value axis into ranges of about the
    same size.  The cuts only balance the work: any cut gives the same ranks.
    """
    counted = df.groupBy(value).agg(F.count("*").alias("__n"))
    number = F.col(value).cast("double")
    sketch = df.agg(F.percentile_approx(number, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("c"))
    cut = counted.withColumn("__cuts", sketch.scalar()).withColumn(
        _BUCKET,
        F.when(F.col(value).isNull(), F.lit(1)).otherwise(-_cuts_below(F.col("__cuts"), number)),
    ).drop("__cuts")
    window = (
        Window.partitionBy(_BUCKET)
        .orderBy(F.col(value).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("__pos", F.coalesce(F.sum("__n").over(window), F.lit(0)))
    sizes = cut.groupBy(_BUCKET).agg(F.sum("__n").alias("__size"))
    # One row per range (at most `pieces`), so this window is small by construction.
    earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(_BUCKET).alias("__ob"),
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias(_BEFORE),
    )
    ranks = local.join(offsets, F.col(_BUCKET) == F.col("__ob")).select(
        F.col(value).alias("__v"), (F.col("__pos") + F.col(_BEFORE) + 1).cast("bigint").alias(name)
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


DIGITS_PER_OCTAVE = 256  # first digits of a value between a power of two and the next
_ENDS = 1 << 40  # digit of what lies beyond every finite value


def _digit(value: Column) -> Column:
    """First digit of a number: never falls as the number rises, and no more than a few million are in use.

    It counts the logarithm in steps, so values of every size are split alike.
    """
    size = F.abs(value)
    steps = (F.floor(F.log2(size) * DIGITS_PER_OCTAVE) + 1100 * DIGITS_PER_OCTAVE).cast("bigint")  # above 0 for the least number
    finite = size < F.lit(float("inf"))
    own = F.when(finite, steps).otherwise(_ENDS)
    return F.when(F.isnan(value), 2 * _ENDS).when(size == 0, 0).when(value < 0, -own).otherwise(own)


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Interpolated percentile per key, exact, without holding a group in one task.

    Equal values are counted first, spread over (key, value).  The counts add up to a histogram by
    first digit, whose size has a bound whatever the data; running sums over it find the one or
    two digits that hold the wanted ranks, and only their values are put in order.
    """
    solid, ks = _solid_keys(df, keys)
    number = F.col(value).cast("double").alias("__v")
    freq = solid.where(F.col(value).isNotNull()).groupBy(*ks, number).agg(F.count("*").alias("__n")).withColumn("__d", _digit(F.col("__v")))
    whole = Window.partitionBy(*ks)
    earlier = whole.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    target = (F.col("__total") - 1) * F.lit(float(p))
    digits = freq.groupBy(*ks, "__d").agg(F.sum("__n").alias("__size"))
    if ks:
        digits = digits.withColumn("__total", F.sum("__size").over(whole))
    else:
        digits = digits.withColumn("__total", freq.agg(F.sum("__n")).scalar())
    digits = digits.withColumn(_BEFORE, F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    digits = digits.withColumns({"__lo": F.floor(target), "__hi": F.ceil(target), "__share": target - F.floor(target)})
    holds = (F.col(_BEFORE) <= F.col("__hi")) & (F.col(_BEFORE) + F.col("__size") > F.col("__lo"))
    wanted = digits.where(holds).select(*ks, "__d", _BEFORE, "__lo", "__hi", "__share")
    inside = Window.partitionBy(*ks, "__d").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    held = freq.join(wanted, [*ks, "__d"])
    if ks:  # at most two digits of a key: one shuffle serves the running sums and the result
        held = held.repartition(*ks)
    placed = held.withColumn("__from", F.col(_BEFORE) + F.coalesce(F.sum("__n").over(inside), F.lit(0)))

    def value_at(rank: str) -> Column:
        here = (F.col("__from") <= F.col(rank)) & (F.col("__from") + F.col("__n") > F.col(rank))
        return F.max(F.when(here, F.col("__v")))

    low, high = value_at("__lo"), value_at("__hi")
    found = placed.groupBy(*ks).agg(low.alias("__low"), high.alias("__high"), F.max("__share").alias("__part"))
    between = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")
    # equal ends need no way between them, which infinite ones do not have
    found = found.withColumn(name, F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(between))
    return found.select(*_original(found, keys), name)


def exact_percentiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], p: float) -> DataFrame:
    """The same percentile of several columns in one pass; columns keep their names."""
    keys = list(keys)
    stacked = df.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(v).alias("__of"), F.col(v).cast("double").alias("__val")) for v in values]))
    )
    found = exact_percentile(stacked, [*keys, "__of"], "__val", p, "__p")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__of") == v, F.col("__p"))).alias(v) for v in values])
