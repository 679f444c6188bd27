"""Token counts of whole texts, huge documents by overlap resynchronisation.

A document of at most ``chunk_chars`` code points is encoded at once.  A longer one is encoded
in overlapping chunks with offsets.  Two neighbouring chunks are spliced at a boundary that is
proven stable; where the overlap holds none, it is doubled, and where it would reach back to
the start of the left chunk, that chunk grows instead, up to the whole text.

Why a common boundary is stable.  The pre-tokenizer scans from left to right and its pattern
looks ahead, never back.  If both chunks begin a pre-token at p, then from p on the right
chunk scans as the whole text does.  Up to p the left chunk does, provided that p is at least
``margin`` code points (the longest special token, and more than the pattern's lookahead)
before its end.  A special token that begins before p and ends after it would be seen whole by
the left chunk, so p would not be a boundary there.  Tokens never cross pre-tokens.  So the
tokens before p of the left chunk and those from p of the right one are those of the text.

Inside a chunk-sized text a segment (white space and the word after it) is a sequence of whole
pre-tokens, because no match goes from a non-blank to a blank.  Segments repeat, so each worker
remembers the counts of those it has met; texts with blanks other than ASCII ones are encoded
without that.  Memory per worker: the remembered segments (bounded) and one document.

Cases: null texts count as empty (no bytes, no tokens); ids may be null or repeated; an empty
table gives no rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
REMEMBERED = 400_000
TOKEN_LIMIT = 512

_SEGMENT = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
_ODD_BLANK = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str):
    """The tokenizer of a file, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def sliceable(path: str) -> bool:
    """Whether the proof above holds: byte-level, split by its own pattern, nothing normalised or prefixed."""
    import json

    spec = json.loads(load(path).to_str())
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain and spec["normalizer"] is None and spec["post_processor"] is None)


def _boundaries(encoding, start: int) -> dict[int, int]:
    """Place in the text of each pre-token's start: number of tokens before it."""
    found: dict[int, int] = {}
    last = None
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last or word is None:
            found[start + at] = i
            last = word
    return found


def spliced_count(text: str, encode: Callable, margin: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of `text`, encoded in overlapping chunks; `encode` gives an encoding with offsets and word ids."""
    total, skip = 0, 0  # `skip`: tokens of the left chunk before its splice point
    low, high = 0, min(chunk, len(text))
    left = encode(text[low:high])
    while high < len(text):
        ours, width, splice = _boundaries(left, low), overlap, None
        while splice is None and high - width > low:
            start = high - width
            end = min(start + chunk + width, len(text))
            right = encode(text[start:end])
            theirs = _boundaries(right, start)
            splice = max((p for p in theirs if p <= high - margin and ours.get(p, -1) >= skip), default=None)
            width *= 2
        if splice is None:
            high = min(low + 2 * (high - low), len(text))
            left = encode(text[low:high])
            continue
        total += ours[splice] - skip
        left, skip, low, high = right, theirs[splice], start, end
    return total + len(left.ids) - skip


class SegmentCounter:
    """Token counts of segments, remembered up to a bound."""

    def __init__(self, path: str, bound: int = REMEMBERED):
        self.tokenizer, self.bound, self.known = load(path), bound, {}

    def count(self, text: str) -> int:
        segments = _SEGMENT.findall(text)
        known = self.known
        new = [s for s in set(segments) if s not in known]
        if new:
            if len(known) + len(new) > self.bound:
                known.clear()
                new = list(set(segments))
            known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return sum(map(known.__getitem__, segments))


@cache
def _counter(path: str) -> SegmentCounter:
    return SegmentCounter(path)


def count_text(text: str, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    if path.endswith(".model"):
        return len(_pieces(path).encode(text, num_threads=1))
    tokenizer = load(path)
    if not sliceable(path):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    encode = lambda part: tokenizer.encode(part, add_special_tokens=False)
    if len(text) > chunk:
        special = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
        return spliced_count(text, encode, max(special, 8), chunk, overlap)
    if _ODD_BLANK.search(text):
        return len(encode(text).ids)
    return _counter(path).count(text)


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text",
    limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    `tokenizer` is a path or a file name that `public_tokenizers` knows; .json files are read by
    tokenizers, .model files by sentencepiece.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)
        for batch in batches:
            n = [0 if (t := v.as_py()) is None else count_text(t, path, chunk, overlap) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
