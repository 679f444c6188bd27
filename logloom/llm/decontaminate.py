"""Benchmark decontamination: item-sized windows, SimHash, Hamming block index, exact verification.

A leak is a window of a document, as many words long as a benchmark item, whose five-word
shingles have a weighted Jaccard similarity of at least ``threshold`` with the item's
(weights are multiplicities).  Steps, all built-in functions:

1. Anchors.  A window that similar shares nearly all its shingles with the item, so it holds
   one that starts at a multiple of ``stride`` (the largest step for which this is certain for
   every item, see `_stride`).  Only those positions are hashed and looked up.  Around each run
   of hits the item-sized windows slide word by word; those with too few shingles of the item
   are skipped.  Windows without an anchor cannot reach the threshold, so nothing is lost.
2. SimHash.  Windows and items get 64-bit fingerprints of their weighted shingles.
3. Multi-index.  A fingerprint is cut into ``radius + 1`` blocks; two within the radius agree
   on one block at least, so the equi-join on (item, block, bits) finds every pair within it.
   The default radius lies five deviations beyond what similarity 0.8 is expected to differ by.
4. Verification of the candidates by the exact weighted similarity.

Words are maximal runs of letters and digits, lower-cased.  An item of fewer than five words
is one shingle of all its words; an item without words leaks nowhere.

Cases: null or empty texts hold no window; ids may be null or repeated (rows with one id are
reported together, null being an id); repeated items are found each; empty tables give no
rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import staged, string_or_empty, table, unused

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 24
# An index of at most this many shingles (40 bytes each) is sent to every executor; beyond it, the join shuffles.
BROADCAST_SHINGLES = 200_000


def words_of(text: Column) -> Column:
    """Words; at most the first and the last piece of the split can be empty."""
    pieces = F.split(F.lower(string_or_empty(text)), r"[^\p{L}\p{N}]+")
    return F.filter(pieces, lambda w: w != "")


def _edge_trimmed(pieces: Column) -> Column:
    """The same words without visiting each: only an outer piece can be empty."""
    first = F.when(pieces[0] == "", 1).otherwise(0)
    last = F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    return F.slice(pieces, first + 1, F.greatest(F.size(pieces) - first - last, F.lit(0)))


def _shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def _shingles(words: Column, size: Column | int) -> Column:
    """All shingles of `size` words, repeats included."""
    width = F.lit(size) if isinstance(size, int) else size
    last = F.size(words) - width
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    ).otherwise(F.array().cast("array<string>"))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(
            F.aggregate(
                hashes, F.lit(0),
                lambda acc, h: acc + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"),
            ) * 2 > F.size(hashes),
            F.call_function("shiftleft", F.lit(1).cast("long"), b),
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def hamming_blocks(fingerprint: Column, radius: int) -> Column:
    """(block, bits) for radius + 1 blocks covering the 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits"),
        )
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(times(a, s), times(b, s)))
    )
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def _stride(shingles: Column, threshold: float) -> Column:
    """The largest step that cannot miss an item of so many shingles.

    A window of m shingles, all matching but u, is certain to have a match at a multiple of k
    if floor(m / k) > u.  Windows clipped by the document's ends are shorter, so the least over
    all lengths that can still reach the threshold counts.
    """
    share = threshold / (1 + threshold)
    # a hair is taken off so that rounding can only make the step smaller
    steps = F.transform(
        F.sequence(F.ceil(shingles * F.lit(threshold - 1e-9)), shingles.cast("long")),
        lambda m: F.floor(m / (m - F.ceil((shingles + m) * F.lit(share - 1e-9)) + 1)),
    )
    return F.greatest(F.array_min(steps), F.lit(1))


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Items with words: item_id, words, n_words, width (of a shingle), shingles, fingerprint, stride."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("n_words", F.size("words")).withColumn("width", F.least(F.col("n_words"), F.lit(SHINGLE_WORDS)))
    return sized.withColumn("shingles", _shingles(F.col("words"), F.col("width"))).select(
        "*", simhash(F.col("shingles")).alias("fingerprint"), _stride(F.size("shingles"), threshold).alias("stride")
    )


def _needed(shingles: Column, of_window: Column, threshold: float) -> Column:
    """The least number of a window's shingles that the item must share."""
    return F.ceil((shingles + of_window) * F.lit(threshold / (1 + threshold) - 1e-9))


def _windows(docs: DataFrame, items: DataFrame, width: int, stride: int, threshold: float) -> DataFrame:
    """Item-sized windows near the anchors: doc_id, item_id, start, shingles.

    An anchor may belong to any window that holds it or a later part of its run.  Those whose
    number of shingles known to the item can reach the threshold are returned.
    """
    place = lambda i: _shingle_hash(F.col("words"), i, width)
    index = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.col("n_words") - width)).alias("q")).select(
        "item_id", "q", place(F.col("q")).alias("hash"),
        F.when(F.col("q") >= stride, place(F.col("q") - stride)).alias("before"),
    )
    known = items.select(F.col("item_id").alias("of_item"), "n_words", F.col("shingles").alias("item_shingles"))
    pieces = docs.select("doc_id", F.split(F.lower(string_or_empty(F.col("text"))), r"[^\p{L}\p{N}]+").alias("pieces"))
    texts = pieces.select("doc_id", _edge_trimmed(F.col("pieces")).alias("words")).where(F.size("words") >= width)
    anchors = texts.select(
        "doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - width, F.lit(stride))).alias("p")
    )
    if index.count() <= BROADCAST_SHINGLES:
        hits = anchors.withColumn("hash", place(F.col("p"))).join(F.broadcast(index), "hash")
        # of a run of anchors on one diagonal only the first is needed
        first = F.col("before").isNull() | (F.col("p") < stride) | (place(F.col("p") - stride) != F.col("before"))
        hits, known = hits.where(first).select("doc_id", "words", "item_id", "p"), F.broadcast(known)
    else:
        narrow = anchors.select(F.col("doc_id").alias("of"), "p", place(F.col("p")).alias("hash")).join(index, "hash")
        narrow = narrow.select("of", "item_id", "p").distinct()
        hits = texts.join(narrow, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")
    low = F.greatest(F.col("p") - F.col("n_words") + 1, F.lit(0))
    high = F.least(F.col("p") + 2 * F.col("n_words"), F.size("words"))
    near = hits.join(known, F.col("item_id").eqNullSafe(F.col("of_item"))).select(
        "doc_id", "item_id", "n_words", "item_shingles", "p", low.alias("low"),
        _shingles(F.slice("words", low + 1, high - low), width).alias("region"),
    )
    near = near.withColumn("known", F.transform("region", lambda s: F.array_contains(F.col("item_shingles"), s).cast("int")))
    n = F.col("n_words") - (width - 1)
    # first shingle and number of shingles of the window at s, inside the region
    begin = lambda s: F.greatest(s, F.lit(0)) - F.col("low")
    count = lambda s: F.least(s - F.col("low") + n, F.size("region")) - begin(s)
    enough = lambda s: F.aggregate(
        F.slice("known", begin(s) + 1, F.greatest(count(s), F.lit(0))), F.lit(0), lambda acc, x: acc + x
    ) >= F.greatest(_needed(n, count(s), threshold), F.lit(1))
    starts = F.filter(F.sequence(F.col("p") - F.col("n_words") + 1, F.col("p") + F.col("n_words") - 1), lambda s: (count(s) > 0) & enough(s))
    return near.withColumn("s", F.explode(starts)).select(
        "doc_id", "item_id", F.greatest("s", F.lit(0)).alias("start"),
        F.slice("region", begin(F.col("s")) + 1, count(F.col("s"))).alias("shingles"),
    )


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """One row per leaked item and document: doc_id, item_id, start (word), similarity of the best window."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = staged(benchmark_items(items, item_id, item_text, threshold), "benchmark")
    windows = None
    # at most five widths: full shingles and those of items shorter than one
    for width, stride in known.groupBy("width").agg(F.min("stride")).orderBy("width").collect():
        part = _windows(docs, known.where(F.col("width") == width), width, stride, threshold)
        windows = part if windows is None else windows.unionAll(part)
    if windows is None:
        return docs.select(
            "doc_id", F.lit(None).cast(known.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"),
            F.lit(0.0).alias("similarity"),
        ).limit(0)
    windows = staged(windows.withColumn("fingerprint", simhash(F.col("shingles"))), "windows")

    blocks = lambda df: df.select("item_id", "fingerprint", F.inline(hamming_blocks(F.col("fingerprint"), radius)))
    probes = blocks(windows.select("item_id", "fingerprint").distinct())
    indexed = blocks(known).withColumnRenamed("fingerprint", "of_item")
    near = (
        probes.join(indexed, (probes.item_id.eqNullSafe(indexed.item_id)) & (probes.block == indexed.block) & (probes.bits == indexed.bits))
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("of_item"))) <= radius)
        .select(probes.item_id.alias("near_item"), F.col("fingerprint").alias("near_fingerprint")).distinct()
    )
    candidates = windows.join(
        near, windows.item_id.eqNullSafe(F.col("near_item")) & (F.col("fingerprint") == F.col("near_fingerprint"))
    )
    texts = known.select(F.col("item_id").alias("text_item"), F.col("shingles").alias("item_shingles"))
    verified = candidates.join(texts, F.col("item_id").eqNullSafe(F.col("text_item"))).select(
        "doc_id", "item_id", "start", weighted_similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")
    ).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    return verified.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.before")).alias("start"), F.col("best.similarity").alias("similarity")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text holds no leak, columns unchanged.

    The decision depends on the text alone, so rows are matched by the text's digest: null and
    repeated ids need no care, and clashing column names cannot arise.
    """
    digest = F.md5(string_or_empty(F.col(text)))
    leaked = find_leaks(docs.select(digest.alias("digest"), F.col(text).alias("text")), items, doc_id="digest", **options)
    key = unused(docs, "__leaked")
    return docs.join(leaked.select(F.col("doc_id").alias(key)).distinct(), digest == F.col(key), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
