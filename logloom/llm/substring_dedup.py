"""Exact substring dedup: repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the leftmost of its
word runs of length ``run`` with the least hash.  Consecutive windows with the same minimiser
(the same place, not just the same value) form a super-k-mer, which travels as one packed
string to the minimiser's bucket.  There the windows are sorted and counted exactly.

1. Every document gives its super-k-mers as numbers only (minimiser, first window, how many).
   Equal windows have equal minimisers, so a minimiser that occurs once holds no repeated
   window; the rest is found by an aggregation and a semi join, before any text moves.
2. Documents meet their remaining super-k-mers and emit the packed strings.  Equal strings of
   one batch are combined: their windows are repeated already, and one of them travels on with
   its count.  A minimiser with very many super-k-mers is split: its windows travel one by one
   to buckets of their own hashes, combined likewise.
3. A bucket sorts its windows; runs with more than one are repeated.  Only word ranges go back.
4. Documents meet their ranges and lose the covered words.

Rows are joined by document id and a digest of the text; rows equal in both are copies of each
other, and what holds for one holds for the other.

Cases: a null text has no words; texts shorter than a window lose nothing; null and repeated
ids and repeated rows are told apart or treated alike as said; an empty table gives no rows;
columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import staged, string_or_empty, table

WINDOW = 35
RUN = 8
# Super-k-mers of one minimiser beyond which its windows travel one by one.
HEAVY = 2_000
# Words hashed at once; longer texts are worked through in overlapping stretches.
STRETCH = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit hash of 64-bit numbers (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + _STEP)


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """Hash of every `run` consecutive words."""
    n = len(words) - run + 1
    total = np.zeros(n, np.uint64)
    for j in range(run):
        total = total * _STEP + words[j : j + n]
    return _mixed(total)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def super_kmers(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of one stretch of words."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = run_hashes(hashes, run)
    place = np.arange(len(runs), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    # the place in the low bits picks the leftmost of equal hashes and tells equal values apart
    least = _sliding_min((runs & ~low) | place, window - run + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(first, len(least)))
    return runs[(least[first] & low).astype(np.int64)], first, count


def _text_super_kmers(words: list[bytes], window: int, run: int):
    """Super-k-mers of a whole text, stretch by stretch; a cut at a stretch's end only makes one more."""
    found = []
    for at in range(0, max(len(words) - window + 1, 0), STRETCH):
        part = words[at : at + STRETCH + window - 1]
        minimiser, first, count = super_kmers(word_hashes(part), window, run)
        found.append((minimiser, first + at, count))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def _repeats_in_bucket(rows: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each (packed words, how often): the runs (first, end) of its windows that occur more than once."""
    distinct = {packed for packed, _ in rows}
    windows, owner = [], []
    spans = []
    for i, (packed, _) in enumerate(rows):
        words = packed.split(b" ")
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        n = len(words) - window + 1
        spans.append(n)
        if len(distinct) == 1:
            continue
        windows += [packed[starts[k] : starts[k + window] - 1] for k in range(n)]
        owner += [(i, k) for k in range(n)]
    repeated = [[] for _ in rows]
    if len(distinct) == 1:  # copies of one string: all or nothing
        again = sum(n for _, n in rows) > 1
        return [[(0, n)] if again else [] for n in spans]
    order = sorted(range(len(windows)), key=windows.__getitem__)
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and windows[order[j]] == windows[order[i]]:
            j += 1
        if j - i > 1 or rows[owner[order[i]][0]][1] > 1:
            for x in order[i:j]:
                row, k = owner[x]
                repeated[row].append(k)
        i = j
    return [_runs(sorted(ks)) for ks in repeated]


def _runs(places: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for k in places:
        if runs and runs[-1][1] == k:
            runs[-1] = (runs[-1][0], k + 1)
        else:
            runs.append((k, k + 1))
    return runs


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN, heavy: int = HEAVY) -> DataFrame:
    """From (doc, digest, text): doc, digest, ranges (array of word ranges low, high covered by repeated windows)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, value in enumerate(batch.column(2)):
                found = _text_super_kmers(value.as_py().encode().split(), window, run)
                if found is not None:
                    rows.append(np.full(len(found[0]), i))
                    parts.append(found)
            if rows:
                minimiser, first, count = (np.concatenate(x) for x in zip(*parts))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(minimiser.view(np.int64)),
                     pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["doc", "digest", "minimiser", "first", "n"],
                )

    schema = f"doc {kind}, digest bigint, minimiser bigint, first int, n int"
    kmers = staged(docs.select("doc", "digest", "text").mapInArrow(listed, schema), "super-kmers")
    often = kmers.groupBy("minimiser").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # a table of its own: a join of two plain shuffles can be split where one minimiser is very common
    often = staged(often.select(F.col("minimiser").alias("again"), (F.col("times") > heavy).alias("heavy")), "repeated")
    hits = kmers.join(often, F.col("minimiser") == F.col("again"))
    per_doc = hits.groupBy(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest")).agg(
        F.collect_set(F.struct("first", "n", "minimiser", "heavy")).alias("hits")
    )
    same = lambda a, b: F.col("doc").eqNullSafe(F.col(a)) & (F.col("digest") == F.col(b))
    loaded = docs.join(per_doc, same("hit_doc", "hit_digest")).select("doc", "digest", "text", "hits")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: dict[tuple[int, bytes], list] = {}  # [row, first, n, how often], the others' places
            others = []
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().encode().split()
                for hit in batch.column(3)[i].as_py():
                    first, n, bucket = hit["first"], hit["n"], hit["minimiser"]
                    spans = [(first, n)] if not hit["heavy"] else [(first + k, 1) for k in range(n)]
                    for at, many in spans:
                        text = b" ".join(words[at : at + many + window - 1])
                        if hit["heavy"]:
                            bucket = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                        known = sent.get((bucket, text))
                        if known is None:
                            sent[bucket, text] = [i, at, many, 1]
                        else:
                            known[3] += 1
                            others.append((i, at, many))
            # what is repeated inside the batch needs no bucket: only its low and high words
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([v[0] for v in sent.values()] + [o[0] for o in others], pa.int64())),
                 batch.column(1).take(pa.array([v[0] for v in sent.values()] + [o[0] for o in others], pa.int64())),
                 pa.array([k[0] for k in sent] + [None] * len(others), pa.int64()),
                 pa.array([k[1] for k in sent] + [None] * len(others), pa.binary()),
                 pa.array([v[1] for v in sent.values()] + [o[1] for o in others], pa.int32()),
                 pa.array([v[2] for v in sent.values()] + [o[2] for o in others], pa.int32()),
                 pa.array([v[3] for v in sent.values()] + [0] * len(others), pa.int32())],
                ["doc", "digest", "bucket", "packed", "first", "n", "times"],
            )

    schema = f"doc {kind}, digest bigint, bucket bigint, packed binary, first int, n int, times int"
    sent = staged(loaded.mapInArrow(packed, schema), "packed")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, group = None, []

        def finish() -> pa.RecordBatch:
            found = _repeats_in_bucket([(r[2], r[5]) for r in group], window)
            out = [(r[0], r[1], r[3] + a, r[3] + b + window - 1) for r, runs in zip(group, found) for a, b in runs]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], doc_type), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                ["doc", "digest", "low", "high"],
            )

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            doc_type = batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):  # doc, digest, packed, first, n, times, bucket
                if row[6] != bucket and group:
                    ready.append(finish())
                    group = []
                bucket = row[6]
                group.append(row)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if group:
            yield finish()

    dealt = sent.where("bucket IS NOT NULL").select("doc", "digest", "packed", "first", "n", "times", "bucket")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    ranges = dealt.mapInArrow(counted, f"doc {kind}, digest bigint, low int, high int")
    local = sent.where("times <> 1").select("doc", "digest", F.col("first").alias("low"), (F.col("first") + F.col("n") + (window - 1)).alias("high"))
    return ranges.unionAll(local).groupBy("doc", "digest").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def kept_words(text: str, ranges: list[dict] | None) -> tuple[int, bytes]:
    """Number of words, and those outside the ranges joined by one space."""
    words = text.encode().split()
    if not ranges:
        return len(words), b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        change[r["low"]] += 1
        change[r["high"]] -= 1
    outside = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return len(words), b" ".join([words[i] for i in outside])


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, heavy: int = HEAVY,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one space) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc"), string_or_empty(F.col(text)).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    ranges = staged(repeated_ranges(rows, window, run, heavy), "ranges")
    ranges = ranges.select(F.col("doc").alias("of"), F.col("digest").alias("of_digest"), "ranges")
    met = rows.join(ranges, F.col("doc").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    kind = rows.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_words(t.as_py(), r.as_py()) for t, r in zip(batch.column(1), batch.column(2))]
            kept = [k for _, k in done]
            n = [n for n, _ in done]
            left = [k.count(b" ") + 1 if k else 0 for k in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([a - b for a, b in zip(n, left)], pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return met.select("doc", "text", "ranges").mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
