"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text is lower-cased, its ASCII punctuation counts as blanks, and every word is the sum of
three hashed embeddings: the word and its first four and five bytes, so that unseen forms of a
known stem are recognised.  Filters of several widths slide over the words; each keeps its
maximum over the whole text, and a dense layer turns the maxima into a score.

Training uses a bounded sample: per class at most ``SAMPLE_PER_CLASS`` labelled rows, those
with the least hashed ids, of texts up to ``SAMPLE_BYTES`` bytes.  A part of it is held back
for early stopping.  Calibration then covers every usable labelled row, of any length: the rows
are scored where they lie, and histograms of the logit by language and class come back.  The
logit is stored, so each text is scored once, and shifted so that 0.5 is the best cut; a
threshold is fitted per language (a language with few toxic rows takes the common one).
Language never enters the score; the thresholds only serve ``flagged``.

Scoring reads every whole text in blocks of words and keeps running maxima, so memory does not
grow with the text.  An embedding meets a filter tap in a table that each worker multiplies
out once; a text is then table look-ups, sums and maxima.

Cases: null and empty texts get the score of a text without words; rows with a null id or
label are not learned from; labels without text and repeated rows do no harm; without rows of
both classes every score is the share of toxic rows (0 without any), cut off below 0.5; an
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import staged, table, unused

SLOTS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 16
SAMPLE_PER_CLASS = 3_000
SAMPLE_BYTES = 20_000
EPOCHS = 12
BATCH = 64
LEARNING_RATE = 0.01
WORD_DROPOUT = 0.2
HELD_SHARE = 5  # one in so many sampled rows is held back
LOGIT_STEPS = 32  # histogram buckets per unit of the logit
LOGIT_REACH = 30  # logits beyond are counted at the ends
MIN_TOXIC = 20  # toxic rows below which a language takes the common threshold
BLOCK = 32_768
REMEMBERED = 150_000

_FOLD = bytes(
    32 if not (c >= 128 or chr(c).isalnum()) else ord(chr(c).lower()) if c < 128 else c for c in range(256)
)


def _slots(word: bytes) -> tuple[int, int, int]:
    return crc32(word) % SLOTS, crc32(word[:4], 1) % SLOTS, crc32(word[:5], 2) % SLOTS


class WordSlots:
    """Embedding rows of words, remembered up to a bound."""

    def __init__(self, bound: int = REMEMBERED):
        self.bound, self.known = bound, {}

    def of(self, text: str) -> np.ndarray:
        """(words, 3) embedding rows of a text."""
        words = text.encode().translate(_FOLD).split()
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in set(words):
            if w not in known:
                a, b, c = _slots(w)
                known[w] = a << 32 | b << 16 | c
        packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 32, packed >> 16 & 0xFFFF, packed & 0xFFFF], axis=1).astype(np.int32)


class Model:
    """Parameters: embeddings (SLOTS, SIZE); per width taps (width, SIZE, FILTERS) and biases; dense weights."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.embedding = f32(rng.normal(0, 0.1, (SLOTS, SIZE)))
        self.taps = [f32(rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS))) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = f32(rng.normal(0, 0.3, FILTERS * len(WIDTHS)))
        self.constant = np.float32(0)
        self.shift = 0.0
        self.fixed: float | None = None  # the score of every text, where nothing could be learned

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.taps, *self.bias, self.dense]

    def snapshot(self) -> tuple:
        return [p.copy() for p in self.parameters()], float(self.constant)

    def restore(self, state: tuple) -> None:
        for p, saved in zip(self.parameters(), state[0]):
            p[...] = saved
        self.constant = np.float32(state[1])


def _padded(slots: np.ndarray) -> np.ndarray:
    """At least as many words as the widest filter; -1 marks none."""
    lack = max(WIDTHS) - len(slots)
    return slots if lack <= 0 else np.concatenate([slots, np.full((lack, 3), -1, np.int32)])


class Scorer:
    """A model with its embedding-by-tap tables multiplied out."""

    def __init__(self, model: Model):
        self.model = model
        taps = np.concatenate([t[j] for t in model.taps for j in range(len(t))], axis=1)
        # the last row stands for no word
        self.tables = np.concatenate([model.embedding @ taps, np.zeros((1, taps.shape[1]), np.float32)])
        self.slots = WordSlots()

    def maxima(self, slots: np.ndarray) -> np.ndarray:
        """Largest response of each filter over a text, block by block."""
        slots = _padded(slots)
        best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        reach = max(WIDTHS) - 1
        for at in range(0, max(len(slots) - reach, 1), BLOCK):
            part = slots[at : at + BLOCK + reach]
            r = self.tables[part[:, 0]] + self.tables[part[:, 1]] + self.tables[part[:, 2]]
            column, found = 0, []
            for width in WIDTHS:
                n = len(part) - width + 1
                total = r[:n, column : column + FILTERS]
                for j in range(1, width):
                    total = total + r[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
                found.append(total.max(axis=0))
                column += width * FILTERS
            best = np.maximum(best, np.concatenate(found))
        return best

    def logit(self, text: str) -> float:
        pooled = np.maximum(self.maxima(self.slots.of(text)) + np.concatenate(self.model.bias), 0)
        return float(pooled @ self.model.dense + self.model.constant) + self.model.shift

    def score(self, text: str) -> float:
        if self.model.fixed is not None:
            return self.model.fixed
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -50, 50))))


class _Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m = [np.zeros_like(p) for p in parameters]
        self.v = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list) -> None:
        """A gradient is an array, or (rows, values) for some rows of a parameter."""
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, m, v, g in zip(self.parameters, self.m, self.v, gradients):
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            p[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)


def _batch_gradients(model: Model, texts: list[np.ndarray], labels: np.ndarray):
    """Gradients of the mean log loss of one batch."""
    texts = [_padded(t) for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    starts = np.append(0, ends[:-1])
    slots = np.concatenate(texts)
    missing = slots[:, 0] < 0
    x = model.embedding[slots[:, 0]] + model.embedding[slots[:, 1]] + model.embedding[slots[:, 2]]
    x[missing] = 0
    pooled, where = [], []
    for width, taps in zip(WIDTHS, model.taps):
        n = len(x) - width + 1
        r = x[:n] @ taps[0]
        for j in range(1, width):
            r = r + x[j : j + n] @ taps[j]
        at = np.stack([s + r[s : e - width + 1].argmax(axis=0) for s, e in zip(starts, ends)])
        where.append(at)
        pooled.append(r[at, np.arange(FILTERS)])
    raw = np.concatenate(pooled, axis=1) + np.concatenate(model.bias)
    active = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.dense + model.constant, -50, 50)))
    error = ((p - labels) / len(labels)).astype(np.float32)
    back = error[:, None] * model.dense * (raw > 0)
    rows, values, taps_g = [], [], []
    for k, (width, taps) in enumerate(zip(WIDTHS, model.taps)):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(taps)
        for j in range(width):
            at = where[k] + j
            # (texts, filters, SIZE): the input each maximum saw at this tap
            grad[j] = np.einsum("tfs,tf->sf", x[at], part)
            rows.append(at.ravel())
            values.append((part[:, :, None] * taps[j].T[None]).reshape(-1, SIZE))
        taps_g.append(grad)
    at, value = np.concatenate(rows), np.concatenate(values)
    live = ~missing[at] & (np.abs(value).sum(axis=1) > 0)
    touched, index = np.unique(slots[at[live]].T.ravel(), return_inverse=True)
    embedding = np.zeros((len(touched), SIZE), np.float32)
    np.add.at(embedding, index, np.tile(value[live], (3, 1)))
    bias = back.sum(axis=0)
    return (
        [(touched, embedding), *taps_g, *(bias[k * FILTERS : (k + 1) * FILTERS] for k in range(len(WIDTHS))), active.T @ error],
        error.sum(),
    )


def _log_loss(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(logits, -50, 50))), 1e-6, 1 - 1e-6)
    return float((weights * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum())


def _best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The logit that separates the classes with the best F1; the middle of the gap where it is clear."""
    order = np.argsort(-logits)
    hit = np.cumsum((weights * labels)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + (weights * labels).sum())
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1  # equal scores are not cut apart
    k = int(np.argmax(f1))
    low = logits[order][k + 1] if k + 1 < len(order) else logits[order][k] - 1
    return float((logits[order][k] + low) / 2)


def train(texts: list[str], labels: list[int], toxic_share: float, seed: int = 7) -> tuple[Model, dict[str, float]]:
    """A model with the cut of its held rows as shift, and the common threshold (as a score) under key "".

    `calibrate` then sets the shift and the thresholds by language from all rows.
    """
    model, y = Model(seed), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        model.fixed = min(toxic_share, 0.49)
        return model, {"": 0.5}
    rng = np.random.default_rng(seed)
    reader = WordSlots()
    slots = [reader.of(t) for t in texts]
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # both classes are held back in proportion
        own = rng.permutation(np.flatnonzero(y == c))
        held[own[: len(own) // HELD_SHARE]] = True
    if len(set(y[held])) < 2:
        held[:] = True  # too few rows to hold any back: they calibrate as well
        fit = np.arange(len(y))
    else:
        fit = np.flatnonzero(~held)
    check = np.flatnonzero(held)
    weights = np.where(y == 1, toxic_share / max((y[check] == 1).mean(), 1e-9), (1 - toxic_share) / max((y[check] == 0).mean(), 1e-9))
    by_class = [fit[y[fit] == c] for c in (0, 1)]
    adam = _Adam(model.parameters(), LEARNING_RATE)
    best, state, stale = np.inf, model.snapshot(), 0
    steps = max(len(fit) // BATCH, 30)
    for _ in range(EPOCHS):
        for _ in range(steps):
            pick = np.concatenate([rng.choice(own, BATCH // 2) for own in by_class])
            batch = [slots[i][rng.random(len(slots[i])) >= WORD_DROPOUT] for i in pick]
            gradients, constant = _batch_gradients(model, batch, y[pick])
            adam.step(gradients)
            model.constant -= np.float32(LEARNING_RATE * constant)
        scorer = Scorer(model)
        logits = np.array([_logit(scorer, slots[i]) for i in check])
        loss = _log_loss(logits + np.log(toxic_share / (1 - toxic_share)), y[check], weights[check])
        if loss < best - 1e-4:
            best, state, stale = loss, model.snapshot(), 0
        elif (stale := stale + 1) > 2:
            break
    model.restore(state)
    scorer = Scorer(model)
    logits = np.array([_logit(scorer, slots[i]) for i in check])
    model.shift = -_best_cut(logits, y[check], weights[check])
    return model, {"": 0.5}


def _logit(scorer: Scorer, slots: np.ndarray) -> float:
    pooled = np.maximum(scorer.maxima(slots) + np.concatenate(scorer.model.bias), 0)
    return float(pooled @ scorer.model.dense + scorer.model.constant) + scorer.model.shift


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES):
    """The bounded sample as pandas (text, toxic, lang), and the share of toxic rows among all usable labels.

    Rows whose crc32(doc_id as text) mod 5 is 0 are never used.  Only ids with a text that is
    short enough use up the sample; they are found by a join of ids alone and the chosen ones
    (at most twice `per_class`) broadcast, so no text is shuffled.
    """
    usable = usable_labels(labels)
    share = usable.agg(F.avg("toxic")).first()[0] or 0.0
    short = docs.where(F.octet_length("text") <= max_bytes)
    able = short.select("doc_id").join(usable.distinct().withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"))
    able = able.select("of", "toxic").distinct()
    picked = None
    for c in (0, 1):
        own = able.where(F.col("toxic") == c).orderBy(F.xxhash64("of"), "of").limit(per_class)
        picked = own if picked is None else picked.unionAll(own)
    sample = short.select("doc_id", "text", "lang").join(F.broadcast(picked), F.col("doc_id") == F.col("of"))
    found = sample.select("doc_id", "text", "toxic", "lang").toPandas().sort_values(["doc_id", "toxic", "text"], kind="stable")
    return found.drop_duplicates(["doc_id", "toxic"]), float(share)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    sample, share = training_sample(docs, labels)
    model, thresholds = train(sample["text"].tolist(), sample["toxic"].tolist(), share)
    return calibrate(docs, labels, model, thresholds)


def counted_logits(scored: DataFrame, labels: DataFrame, logit: str) -> pd.DataFrame:
    """(lang, toxic, logit, n) over all usable labelled rows; its size depends on the number of languages alone."""
    known = usable_labels(labels).distinct().select(F.col("doc_id").alias("__of"), "toxic")
    narrow = scored.select("doc_id", "lang", F.greatest(F.least(F.col(logit), F.lit(LOGIT_REACH)), F.lit(-LOGIT_REACH)).alias("logit"))
    counted = narrow.join(known, F.col("doc_id") == F.col("__of")).groupBy("lang", "toxic", F.floor(F.col("logit") * LOGIT_STEPS).alias("bucket"))
    found = counted.agg(F.count(F.lit(1)).alias("n")).toPandas()
    found["logit"] = (found["bucket"].astype("float64") + 0.5) / LOGIT_STEPS
    return found.sort_values(["bucket", "toxic"], kind="stable")


def logit_histogram(docs: DataFrame, labels: DataFrame, model: Model) -> pd.DataFrame:
    """`counted_logits` of texts not scored yet.  Scores are taken before the labels are joined, so no text is shuffled."""
    scored = docs.select("doc_id", "lang", logits(F.col("text"), model, docs.sparkSession).alias("logit"))
    return counted_logits(scored, labels, "logit")


def cuts(found: pd.DataFrame) -> tuple[float, dict[str, float]]:
    """From counted logits: the best common cut, and the thresholds (as scores once it is taken off)."""
    if found["toxic"].nunique() < 2:
        return 0.0, {"": 0.5}
    cut_of = lambda x: _best_cut(x["logit"].to_numpy(), x["toxic"].to_numpy(np.float64), x["n"].to_numpy(np.float64))
    common = cut_of(found)
    thresholds = {"": 0.5}
    for lang, own in found.groupby("lang"):
        sizes = own.groupby("toxic")["n"].sum()
        if lang and min(sizes.get(0, 0), sizes.get(1, 0)) >= MIN_TOXIC:
            thresholds[str(lang)] = float(1 / (1 + np.exp(-np.clip(cut_of(own) - common, -50, 50))))
    return common, thresholds


def calibrate(docs: DataFrame, labels: DataFrame, model: Model, thresholds: dict[str, float]) -> tuple[Model, dict[str, float]]:
    """`model` with its shift, and the thresholds, from all usable labelled rows."""
    if model.fixed is not None:
        return model, thresholds
    common, thresholds = cuts(logit_histogram(docs, labels, model))
    model.shift -= common
    return model, thresholds


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: list[str], score: str) -> tuple[DataFrame, dict[str, float]]:
    """The columns `keep` of every row of `docs` with its calibrated score, and the thresholds.

    Each text is scored once: the logits are stored, the cuts are taken from them, and the shift,
    which is a constant, is added afterwards.
    """
    sample, share = training_sample(docs, labels)
    model, thresholds = train(sample["text"].tolist(), sample["toxic"].tolist(), share)
    if model.fixed is not None:
        return docs.select(*keep, F.lit(float(model.fixed)).alias(score)), thresholds
    held = staged(docs.select(*keep, logits(F.col("text"), model, docs.sparkSession).alias(score)), "logits")
    common, thresholds = cuts(counted_logits(held, labels, score))
    shifted = F.greatest(F.least(F.col(score) - F.lit(common), F.lit(50.0)), F.lit(-50.0))
    return held.withColumn(score, 1 / (1 + F.exp(-shifted))), thresholds


@lru_cache(maxsize=2)
def _scorer(packed: bytes) -> Scorer:
    return Scorer(pickle.loads(packed))


def logits(text: Column, model: Model, spark: SparkSession) -> Column:
    """The logit of every whole text, with the model's shift, as a column."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(shared.value)
        for part in parts:
            yield pd.Series([scorer.logit(t or "") for t in part], dtype="float64")

    return found(F.coalesce(text.cast("string"), F.lit("")))


def scores(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of every whole text, as a column."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(shared.value)
        for part in parts:
            yield pd.Series([scorer.score(t or "") for t in part], dtype="float64")

    return scored(F.coalesce(text.cast("string"), F.lit("")))


def toxic_by_language(score: Column, lang: Column, thresholds: dict[str, float]) -> Column:
    """Whether a score reaches the threshold of its language."""
    cut = F.lit(thresholds[""])
    for name, value in sorted(thresholds.items()):
        if name:
            cut = F.when(lang == name, F.lit(value)).otherwise(cut)
    return score >= cut


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not toxic by their language's threshold; columns unchanged."""
    score = unused(docs, "__score")
    scored, thresholds = fit_and_score(docs, labels, docs.columns, score)
    return scored.where(~toxic_by_language(F.col(score), F.col("lang"), thresholds)).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, thresholds = fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"], "score")
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxic_by_language(F.col("score"), F.col("lang"), thresholds).alias("flagged"),
    )
