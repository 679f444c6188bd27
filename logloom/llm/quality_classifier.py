"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document.

A word of a text, with a blank on either side, has one feature for itself and one for each of
its byte n-grams of ``GRAMS`` lengths; every two neighbouring words have one more (a word that
follows itself has the same one whatever the word).  A feature hashes to one of ``SLOTS`` vectors.
A document is the mean of the vectors of all its features, repeats included; a softmax layer over
the mean gives the probabilities of the two labels.  Vectors and layer are trained together by
numpy stochastic gradient descent, on batches that draw both labels equally.  The margin is
then shifted so that 0.5 is the best cut of the rows held back, counted by the labels' shares.

Training uses a bounded sample: per label at most ``SAMPLE_PER_LABEL`` rows, those with the least
hashed ids among the labelled rows that have a text of at most ``SAMPLE_BYTES`` bytes.  A part of
it is held back; training keeps the state with the least loss there.

Scoring reads every whole text, block by block.  The softmax needs only the difference of the two
outputs, so each slot is one number on the workers, and a block is a look-up of all its features at once.

Cases: null and empty texts, and texts of blanks, have no features and get the labels' odds
as score; rows with a null id or another label are not learned from; a labelled row without a
text, with a null text or one beyond the bound is not learned from and leaves its place to
another; repeated rows count once in the sample; an id with both labels is learned with both;
without rows of both labels every score is the share of label 1 (0.5 without any rows); an empty
table gives no rows.  Only doc_id and text of the documents are read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table

SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
SIZE = 8
GRAMS = (3, 4)
SAMPLE_PER_LABEL = 1_500
SAMPLE_BYTES = 8_000
EPOCHS = 8
BATCH = 64
RATE = 200.0  # of the vectors: a slot is a small share of a text, and so is its gradient
OUTPUT_RATE = 0.5
HELD_SHARE = 5  # one in so many sampled rows is held back
PATIENCE = 3
BLOCK = 1 << 18  # bytes of a text whose features are held at a time

REPEAT = 0  # slot of a word that follows itself

_BLANK = re.compile(rb"[\x09-\x0D\x20]")
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)  # multiplier of the hashes; odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (_ODD, _INVERSE))


def _slot(x: np.ndarray) -> np.ndarray:
    mixed = x * _ODD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def block_slots(words: bytes, before: np.uint64 | None) -> tuple[np.ndarray, np.uint64 | None]:
    """The slots of all features of some words, and the hash of the last; `before` is that of the word ahead.

    All words at once: a word's hash is a difference of running sums, an n-gram is a number.
    """
    line = np.frombuffer(b" " + words.translate(_SPACES) + b" ", np.uint8)
    inner = line != 32
    edges = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int32), before
    n = 1 << (len(line) - 1).bit_length()  # few sizes, so that the powers are kept
    up, down = (p[: len(line)] for p in _powers(n))
    running = np.concatenate([[np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    hashes = (running[ends] - running[starts]) * down[starts]
    found = [_slot(hashes + np.uint64(1))]
    wide = line.astype(np.uint64)
    for size in GRAMS:
        whole = inner[1 : len(line) - size + 2].copy()  # only the first and the last byte may be a word's edge
        for j in range(2, size - 1):
            whole &= inner[j : len(line) - size + 1 + j]
        at = np.flatnonzero(whole)
        code = np.full(len(at), size, np.uint64)
        for j in range(size):
            code = code << np.uint64(8) | wide[at + j]
        found.append(_slot(code))
    chain = hashes if before is None else np.concatenate([[before], hashes])
    first, second = chain[:-1], chain[1:]
    found.append(np.where(first == second, REPEAT, _slot(first * np.uint64(3) + second)).astype(np.int32))
    return np.concatenate(found), hashes[-1]


def text_slots(text: str, size: int = 0) -> Iterator[np.ndarray]:
    """The slots of all features of a text, in parts of about `size` (BLOCK) bytes of it, cut at blanks."""
    data, start, before = text.encode("utf-8", "surrogatepass"), 0, None
    while start < len(data):
        cut = _BLANK.search(data, start + (size or BLOCK))
        end = cut.start() if cut else len(data)
        slots, before = block_slots(data[start:end], before)
        yield slots
        start = end


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and how much of its features each is."""
    found, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *text_slots(text)]), return_counts=True)
    return found, (counts / max(counts.sum(), 1)).astype(np.float32)


class Model:
    """vectors (SLOTS, SIZE), output (SIZE, 2), bias (2); `shift` is added to the difference of the outputs."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (SLOTS, SIZE)).astype(np.float32)
        self.output = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.shift = 0.0
        self.fixed: float | None = None  # the score of every text, where nothing could be learned

    def mean(self, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of the features of a text, as `features` gives them."""
        return own[1] @ self.vectors[own[0]]

    def margins(self) -> np.ndarray:
        """What one feature of each slot adds to the difference of the two outputs."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(model: Model, batch: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
    """Of the mean log loss of a batch: (touched slots, their vectors' gradient), output, bias."""
    means = np.stack([model.mean(f) for f in batch])
    error = softmax(means @ model.output + model.bias)
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    back = error @ model.output.T
    slots = np.concatenate([f[0] for f in batch])
    owner = np.repeat(np.arange(len(batch)), [len(f[0]) for f in batch])
    share = np.concatenate([f[1] for f in batch])
    touched, at = np.unique(slots, return_inverse=True)
    grown = np.stack([np.bincount(at, share * back[owner, k], len(touched)) for k in range(SIZE)], axis=1)
    return (touched, grown.astype(np.float32)), means.T @ error, error.sum(axis=0)


def loss(model: Model, batch: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> float:
    """Mean over the labels of the mean log loss of a label's rows."""
    p = softmax(np.stack([model.mean(f) for f in batch]) @ model.output + model.bias)
    own = -np.log(np.clip(p[np.arange(len(labels)), labels], 1e-7, 1))
    return float(np.mean([own[labels == c].mean() for c in np.unique(labels)]))


def train(texts: list[str], labels: list[int], share: float, seed: int = 11) -> Model:
    """A model from a sample; `share` is the share of label 1 among all usable rows."""
    model, y = Model(seed), np.array(labels, np.int64)
    if len(set(labels)) < 2:
        model.fixed = share
        return model
    sample = [features(t) for t in texts]
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        held[own[: len(own) // HELD_SHARE]] = True
    check = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    fit = [np.flatnonzero((y == c) & ~held) for c in (0, 1)]
    watched = [sample[i] for i in check]
    best, state, stale = np.inf, None, 0
    steps = max(sum(map(len, fit)) // BATCH, 20)
    for epoch in range(EPOCHS):
        decay = 1 - epoch / EPOCHS
        for _ in range(steps):
            pick = np.concatenate([rng.choice(own, BATCH // 2) for own in fit])
            (touched, grown), output, bias = gradients(model, [sample[i] for i in pick], y[pick])
            model.vectors[touched] -= RATE * decay * grown
            model.output -= (OUTPUT_RATE * decay * output).astype(np.float32)
            model.bias -= (OUTPUT_RATE * decay * bias).astype(np.float32)
        now = loss(model, watched, y[check])
        if now < best - 1e-4:
            best, stale = now, 0
            state = (model.vectors.copy(), model.output.copy(), model.bias.copy())
        elif (stale := stale + 1) >= PATIENCE:
            break
    if state is not None:
        model.vectors, model.output, model.bias = state
    means = np.stack([model.mean(f) for f in watched])
    margins = (means @ model.output + model.bias) @ np.array([-1, 1])
    model.shift = -best_cut(margins, y[check], share)
    return model


def best_cut(margins: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The margin that tells the labels apart with the least expected error; the middle of the gap."""
    order = np.argsort(margins, kind="stable")
    sorted_margins, one = margins[order], labels[order] == 1
    lost = np.append(0, np.cumsum(one)) * share / max(one.sum(), 1)  # label 1 below the cut
    let = (~one).sum() - np.append(0, np.cumsum(~one))  # label 0 above it
    errors = lost + let * (1 - share) / max((~one).sum(), 1)
    edges = np.concatenate([[sorted_margins[0] - 2], sorted_margins, [sorted_margins[-1] + 2]])
    open_ = np.append(np.append(True, sorted_margins[1:] > sorted_margins[:-1]), True)  # equal margins are not cut apart
    k = int(np.argmin(np.where(open_, errors, np.inf)))
    return float((edges[k] + edges[k + 1]) / 2)


class Scorer:
    """One number per slot; a text is the mean of its features' numbers."""

    def __init__(self, margins: np.ndarray, constant: float, fixed: float | None):
        self.margins, self.constant, self.fixed = margins, constant, fixed

    def score(self, text: str) -> float:
        if self.fixed is not None:
            return self.fixed
        total, n = 0.0, 0
        for slots in text_slots(text):
            total += float(self.margins[slots].sum())
            n += len(slots)
        margin = total / n if n else 0.0
        return float(1 / (1 + np.exp(-np.clip(margin + self.constant, -500, 500))))


def scorer_of(model: Model) -> Scorer:
    margins = np.zeros(SLOTS) if model.fixed is not None else model.margins()
    return Scorer(margins, float(model.bias[1] - model.bias[0]) + model.shift, model.fixed)


@lru_cache(maxsize=2)
def _scorer(packed: bytes) -> Scorer:
    return Scorer(*pickle.loads(packed))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_bytes: int = SAMPLE_BYTES):
    """The bounded sample as pandas (doc_id, text, quality), and the share of label 1 among all usable labels.

    Ids are chosen by a join of ids alone; only the chosen ones (at most twice `per_label`) are
    broadcast to fetch their texts.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality")).distinct()
    share = usable.agg(F.avg("quality")).first()[0]
    texts = docs.where(F.octet_length(F.col("text").cast("string")) <= max_bytes).select("doc_id", F.col("text").cast("string").alias("text"))
    able = texts.select("doc_id").join(usable, F.col("doc_id") == F.col("of")).select("of", "quality").distinct()
    picked = None
    for c in (0, 1):
        own = able.where(F.col("quality") == c).orderBy(F.xxhash64("of"), "of").limit(per_label)
        picked = own if picked is None else picked.unionAll(own)
    # one text per id: rows that share an id give their least text
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return rows.toPandas().sort_values(["doc_id", "quality"], kind="stable"), 0.5 if share is None else float(share)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, share = training_sample(docs, labels)
    return train(sample["text"].tolist(), sample["quality"].tolist(), share)


def scores(text: Column, model: Model, spark: SparkSession) -> Column:
    """The probability of label 1 for every whole text, as a column."""
    own = scorer_of(model)
    shared = spark.sparkContext.broadcast(pickle.dumps((own.margins, own.constant, own.fixed)))  # SLOTS numbers

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(shared.value)
        for part in parts:
            yield pd.Series([scorer.score(t or "") for t in part], dtype="float64")

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", scores(F.col("text"), model, spark).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
