"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets counts and, from them, rates (symbols and upper-case letters per character,
repeated lines and words, length of words).  A sketch of a rate is a histogram over
logarithmic buckets: its quantiles have a bounded relative error, and two sketches merge by
adding counts, which is what a grouped sum does.  So the sketches of all languages and sources
come from one aggregation that combines before the shuffle, have a bounded size, and do not
depend on the order of rows.

A threshold is the median plus a multiple of the distance from the median to a quantile far
enough out to see the spread of ordinary documents (``REACH``): the upper quartile for symbols,
in which junk may hold a fifth of a group; the ninth decile for letters and word length (the
first for short words); the 99th percentile for repetition, which most documents lack.  Most
documents have no symbols at all; where the upper quartile does not differ from the median, the
limit is where the sketch falls apart best into a low and a high part (the split with the
greatest variance between the parts, on the logarithmic scale; ``split_of``).  Only
documents that pass the base rules enter the sketches.  ``FLOORS`` are small and serve where a
group has no spread, since then no multiple of it is a distance.  A (language, source) with
fewer than ``MIN_GROUP`` rows merges into the sketch of its language, and a language that is
as small into the whole, so that no group is judged by a handful of rows.  The thresholds are
joined back by group and the documents filtered.

Words end at ASCII blanks.  Repeated windows are found by hash and confirmed on the words.

Cases: a null text has no words and fails the base rules; null languages and sources are
groups of their own; a text without words has no rates and enters no sketch; null and repeated
ids and repeated rows are judged row by row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import staged, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

ACCURACY = 0.02  # relative error of a quantile
SMALLEST = 1e-4  # rates below it share one bucket
MIN_GROUP = 200
# The quantile whose distance from the median is taken, and how often; below 0.5 for the lower side.
REACH = {
    "symbol_rate": (0.75, 6.0), "upper_rate": (0.9, 10.0), "dup_line_rate": (0.99, 2.0), "repeat_rate": (0.99, 2.0),
    "long_words": (0.9, 10.0), "short_words": (0.1, 6.0),
}
# Rates that most documents lack: limited by the split of the sketch where REACH shows no spread.
SPLIT = ("symbol_rate",)
ABSENT = 1e-3  # rates below it are alike in a split
# Least distance of a threshold from the median; the sign is the side on which outliers are dropped.
FLOORS = {"symbol_rate": 0.02, "upper_rate": 0.02, "dup_line_rate": 0.2, "repeat_rate": 0.1, "long_words": 0.5, "short_words": -0.5}

_UPPER = bytes(range(65, 91))
_BLANK_LINE = re.compile(r"[\x20\x09-\x0D]*\Z")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur more than once in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _MULTIPLIER + hashes[j : j + n]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    suspect = np.zeros(n, bool)
    suspect[order[1:][same]] = True
    suspect[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for at in np.flatnonzero(suspect).tolist():
        seen.setdefault(tuple(words[at : at + size]), []).append(at)
    change = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for at in places:
                change[at] += 1
                change[at + size] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper."""
    data = text.encode()
    words = data.split()
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if not _BLANK_LINE.match(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper = len(data) - len(data.translate(None, _UPPER))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), lines, dup, repeated_words(words), upper


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` and the counts of every row's text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(v.as_py() or "") for v in batch.column(len(keys))]
            columns = zip(*found) if found else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], *(pa.array(c, pa.int64()) for c in columns)], [*keys, *COUNTS]
            )

    rows = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(count, kinds + "".join(f", {c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Rates by name; null for a text without words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    length = share("word_chars", "n_words")
    return {
        "symbol_rate": share("n_symbols", "word_chars"), "upper_rate": share("n_upper", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"), "repeat_rate": share("n_repeat_words", "n_words"),
        "long_words": length, "short_words": length,
    }


def _gamma() -> float:
    return (1 + ACCURACY) / (1 - ACCURACY)


def bucket_of(value: Column) -> Column:
    return F.ceil(F.log(F.greatest(value, F.lit(SMALLEST))) / float(np.log(_gamma()))).cast("int")


def bucket_value(bucket: Column) -> Column:
    """Middle of a bucket; the lowest one stands for zero."""
    low = int(np.ceil(np.log(SMALLEST) / np.log(_gamma())))
    return F.when(bucket <= low, F.lit(0.0)).otherwise(F.pow(F.lit(_gamma()), bucket) * (2 / (1 + _gamma())))


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """From groups and (rate, value): groups, rate, bucket, n.  Sketches merge by adding n."""
    return rows.where("value IS NOT NULL").groupBy(*groups, "rate", bucket_of(F.col("value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rate", "bucket").agg(F.sum("n").alias("n"))


def split_of(buckets: Column, size: Column) -> Column:
    """Lower end of the high part of a sketch, split where the variance between both parts is greatest.

    `buckets` is the sorted list of (bucket, n), of bounded length; null if all values share a bucket.
    """
    absent = int(np.ceil(np.log(ABSENT) / np.log(_gamma())))
    at = lambda b: F.greatest(b["bucket"], F.lit(absent)).cast("double")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + b["n"] * at(b))

    def step(acc: Column, b: Column) -> Column:
        above = size - acc["n"]
        apart = acc["x"] / acc["n"] - (total - acc["x"]) / above
        found = F.when(acc["n"] > 0, F.struct((acc["n"] * above * apart * apart).alias("v"), b["bucket"].alias("bucket")))
        better = found["v"] > F.coalesce(acc["best"]["v"], F.lit(0.0))
        return F.struct(
            (acc["n"] + b["n"]).alias("n"), (acc["x"] + b["n"] * at(b)).alias("x"),
            F.when(better, found).otherwise(acc["best"]).alias("best"),
        )

    start = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(None).cast("struct<v: double, bucket: int>").alias("best")
    )
    best = F.aggregate(buckets, start, step)["best"]["bucket"]
    return F.pow(F.lit(_gamma()), best - 1)


def quantiles(sketch: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, rate, size, a column per quantile, and split.  A sketch has a bounded number of buckets."""
    listed = sketch.groupBy(*groups, "rate").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("buckets"), F.sum("n").alias("size")
    )
    def at(share: float) -> Column:
        walked = F.aggregate(
            "buckets", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("bucket")),
            lambda acc, b: F.struct(
                (acc["sum"] + b["n"]).alias("sum"),
                F.coalesce(acc["bucket"], F.when(acc["sum"] + b["n"] >= F.lit(share) * F.col("size"), b["bucket"])).alias("bucket"),
            ),
        )
        return bucket_value(walked["bucket"])

    split = split_of(F.col("buckets"), F.col("size")).alias("split")
    return listed.select(*groups, "rate", "size", *(at(s).alias(name) for name, s in shares.items()), split)


def thresholds(sketch: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per group: the groups and a map from rate to limit.

    `sketch` is that of all groups; coarser ones are merged from it.
    """
    names = {q: f"q{round(100 * q)}" for q in sorted({0.5, *(q for q, _ in REACH.values())})}
    shares = {name: q for q, name in names.items()}
    fine = quantiles(sketch, list(groups), shares)
    coarse = quantiles(merged(sketch, [groups[0]]), [groups[0]], shares)
    whole = quantiles(merged(sketch, []), [], shares)
    values = lambda: F.struct(*shares, "split")
    coarse = coarse.select(F.col(groups[0]).alias("of"), F.col("rate").alias("of_rate"), F.col("size").alias("coarse_size"), values().alias("coarse"))
    whole = whole.select(F.col("rate").alias("any_rate"), values().alias("whole"))
    chosen = (
        fine.select(*groups, "rate", "size", values().alias("fine"))
        .join(coarse, F.col(groups[0]).eqNullSafe(F.col("of")) & (F.col("rate") == F.col("of_rate")))
        .join(whole, F.col("rate") == F.col("any_rate"))
        .withColumn(
            "q", F.when(F.col("size") >= MIN_GROUP, F.col("fine")).when(F.col("coarse_size") >= MIN_GROUP, F.col("coarse"))
            .otherwise(F.col("whole"))
        )
    )
    by_rate = lambda found: F.create_map(*[x for rate in FLOORS for x in (F.lit(rate), found(rate))])[F.col("rate")]
    floor = by_rate(lambda rate: F.lit(FLOORS[rate]))
    # negative on the lower side, like the floor
    spread = by_rate(lambda rate: F.lit(REACH[rate][1]) * (F.col("q")[names[REACH[rate][0]]] - F.col("q.q50")))
    apart = F.when(F.col("rate").isin(*SPLIT) & (spread == 0), F.col("q.split") - F.col("q.q50"))
    spread = F.coalesce(apart, spread)
    limit = F.col("q.q50") + F.when(floor > 0, F.greatest(spread, floor)).otherwise(F.least(spread, floor))
    return chosen.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rate", limit.alias("limit")))).alias("limits"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept, and the rates that failed (broken)."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")
    )
    counts = staged(measured(rows, ["doc_id", "lang", "source"]), "quality")
    listed = counts.where(~base_failed()).select("lang", "source", F.explode(F.create_map(*[x for k, v in rates().items() for x in (F.lit(k), v)])).alias("rate", "value"))
    limits = thresholds(staged(sketches(listed, ["lang", "source"]), "sketches"))
    limits = limits.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "limits")
    met = counts.join(
        limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    broken = F.filter(
        F.array(*[
            F.when(v > F.col("limits")[k] if FLOORS[k] > 0 else v < F.col("limits")[k], F.lit(k)) for k, v in rates().items()
        ]),
        lambda x: x.isNotNull(),
    )
    return met.withColumn("broken", broken).withColumn("base_failed", base_failed()).select(
        "doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken"),
    )
