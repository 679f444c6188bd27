"""Sequence packing by minimum bin slack over the histogram of remaining lengths.

Documents are tokenized once and cut into full windows and one remainder.  Packing looks only
at the histogram of lengths, which has at most ``capacity`` entries whatever the corpus: a
bitset subset-sum finds, with the largest remaining length in the window, the multiset of
lengths that fills it closest to capacity; backtracking gives the counts, and the pattern is
used as often as the histogram allows.  Every use exhausts a length down to less than its
multiplicity, so the patterns are few as well.

Pieces of one length are interchangeable.  They are numbered, and a pattern's plan line says
which numbers it takes and where they lie.  Numbering cuts a length into hash buckets and adds
the sizes of the earlier ones, so a length that a third of all pieces share is spread too.
The plan (bounded as said) is broadcast; rows shuffled hold no text and no ids.

Cases: a null text is empty and consists of the closing id alone; null and repeated ids and
repeated rows are packed row by row; equal pieces are interchangeable; an empty table gives no
rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import staged, table
from logloom.llm.token_counts import load, tokenizer_path

CAPACITY = 2048
CLOSING_ID = 1
REMEMBERED = 600_000
BUCKET_ROWS = 8_000

# An ASCII or Latin-1 letter, then the punctuation that ends a word.  The letter ends a run of
# letters, so what follows is a pre-token of its own, whatever the word.
_ENDING = re.compile(r"([a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\[-`{-~]+)\Z", re.I)
# Words of letters that have one form only: no normalisation but lower case applies to them,
# and they are one pre-token.
_LETTERS = re.compile(r"[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+\Z", re.I)
_PROBES = ["a", "Word", "straße", "ÉTÉ", "señor", "internationalisation"]


def _byte_characters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: visible ones as themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


_CHARACTERS = _byte_characters()


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _stem_and_ending(word: bytes) -> tuple[bytes, bytes]:
    """Two parts whose ids follow each other in those of the word; the second may be empty.

    A stem of ASCII letters is lower-cased, as the tokenizer does, to be met more often.
    """
    if word.isalpha():  # of bytes: ASCII letters alone
        return word.lower(), b""
    if word[:-1].isalpha() and word[-1:] in b".,!?;:|":
        return word[:-1].lower(), word[-1:]
    text = word.decode()
    ending = _ENDING.search(text)
    # a quote may begin a contraction with what follows, an angle bracket a special token
    if ending is None or "'" in text or "<" in text:
        return word, b""
    return text[: ending.end(1)].encode(), ending[2].encode()


class WordIds:
    """Token ids, as little-endian bytes, of words between ASCII blanks, remembered up to a bound.

    The word tokenizer drops white space and never joins what it separates, so the ids of a
    text are those of its words in a row.  Words are kept in two generations of half the bound:
    a full one replaces the older one, and what is met there moves to the new one, so the frequent
    words stay known.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        self.tokenizer, self.bound = load(path), bound
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {b"": b""}
        # plain letters may go to the vocabulary directly where that is what the tokenizer does
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(_PROBES, add_special_tokens=False)]
        self.direct = whole == [self._letter_ids(p) for p in _PROBES]

    def _letter_ids(self, letters: str) -> list[int]:
        written = letters.lower()
        if not written.isascii():  # ASCII letters stand for themselves
            written = written.encode().decode("latin-1").translate(_CHARACTERS)
        return [token.id for token in self.model.tokenize(written)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = {t: _packed(self._letter_ids(t)) for t in texts if self.direct and _LETTERS.match(t)}
        rest = [t for t in texts if t not in found]
        if rest:
            encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            found.update((t, _packed(e.ids)) for t, e in zip(rest, encoded))
        return [found[t] for t in texts]

    def _learn(self, new: list[bytes]) -> None:
        parts = [_stem_and_ending(w) for w in new]
        stems = self.stems
        missing = [s for s in {x for pair in parts for x in pair} if s not in stems]
        if missing:
            stems.update(zip(missing, self._encode([s.decode() for s in missing])))
        self.words.update((w, stems[a] + stems[b]) for w, (a, b) in zip(new, parts))

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        new = [w for w in set(words) if w not in self.words]
        if new:
            if len(self.words) + len(new) > self.bound // 2:
                self.older, self.words, self.stems = self.words, {}, {b"": b""}
                new = set(words)
            older = self.older
            self.words.update((w, older[w]) for w in new if w in older)
            self._learn([w for w in new if w not in older])
        return b"".join(map(self.words.__getitem__, words))


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


@cache
def _drops_blanks(path: str) -> bool:
    """Whether the tokenizer is one that drops white space: only then words may be encoded apart."""
    import json

    split = json.loads(load(path).to_str())["pre_tokenizer"] or {}
    first = (split.get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and bool(first.get("invert")) and pattern.endswith(r"[^\s\p{L}\p{N}]+")


def token_ids(text: str, path: str) -> bytes:
    """The ids of a text, 4 bytes each."""
    if not _drops_blanks(path):
        return _packed(load(path).encode(text, add_special_tokens=False).ids)
    return _word_ids(path).ids(text.encode("utf-8"))


def cut_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    closing = _packed([closing_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = token_ids(value.as_py() or "", path) + closing
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
                    total.append(n)
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def fullest(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """The multiset with the largest length whose sum is closest to capacity: length -> how many.

    Bit s of a bitset says that sum s can be had; one bitset is kept per step for backtracking.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first = lengths[0]
    goal = capacity - first
    mask = (1 << (goal + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > goal:
            continue
        left = min(counts[length] - (length == first), goal // length)
        times = 1
        while left > 0 and not reach >> goal & 1:  # multiplicities 1, 2, 4, ... make up any count
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            left -= take
            times *= 2
        if reach >> goal & 1:
            break
    rest = reach.bit_length() - 1
    chosen = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + take
            rest -= take * length
    return chosen


def plan_windows(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Plan lines (length, first number, end number, sequence base, multiplicity, offset base)."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    lines, sequence = [], 0
    while left:
        pattern = fullest(left, capacity)
        times = min(left[n] // m for n, m in pattern.items())
        offset = 0
        for length, many in sorted(pattern.items(), reverse=True):
            used = many * times
            lines.append((length, taken[length], taken[length] + used, sequence, many, offset))
            taken[length] += used
            left[length] -= used
            if not left[length]:
                del left[length]
            offset += many * length
        sequence += times
    return lines


def _numbered(pieces: DataFrame) -> DataFrame:
    """`pieces` with `number`: 0, 1, ... within each length."""
    buckets = max(1, pieces.count() // BUCKET_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(sizes, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("rank"))


def pack(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = staged(cut_documents(docs, tokenizer, doc_id, text, capacity, closing_id), "pieces")
    # at most `capacity` rows
    histogram = {n: c for n, c in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan = pieces.sparkSession.createDataFrame(
        plan_windows(histogram, capacity),
        "length bigint, low bigint, high bigint, sequence bigint, many bigint, base bigint",
    )
    inside = F.col("number") - F.col("low")
    placed = _numbered(pieces).withColumnRenamed("length", "piece_length").join(
        F.broadcast(plan),
        (F.col("piece_length") == F.col("length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")),
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(inside / F.col("many"))).alias("sequence_id"),
        (F.col("base") + inside % F.col("many") * F.col("length")).alias("offset"),
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
