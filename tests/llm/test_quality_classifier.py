"""The quality classifier: gradients, scoring against a plain average, odd inputs, held-out accuracy."""

import zlib

import numpy as np
import pytest
from logloom.llm import quality_classifier as q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def plain_features(text):
    """Every feature as a pair of its kind and what it stands for, word by word."""
    words = text.encode().split()
    out = [("word", w) for w in words]
    out += [(n, framed[i : i + n]) for n in q.GRAMS for w in words for framed in [b" " + w + b" "] for i in range(len(framed) - n + 1)]
    return out + [("repeat", b"") if a == b else ("pair", (a, b)) for a, b in zip(words, words[1:])]


TEXTS = ["", "  \n", "word", "a", "w w w x", "é ü\tß\x0bz", "a b " * 400, "+++ --- !!", "x" * 900 + " y", " lead and trail "]


def test_gradients_follow_the_loss():
    model = q.Model(3)
    batch = [q.features(x) for x in ("a b c d e", "one", "", "the the quick brown fox", "b c")]
    labels = np.array([1, 0, 1, 0, 1])

    def mean_loss():
        p = q.softmax(np.stack([model.mean(f) for f in batch]) @ model.output + model.bias)
        return float(-np.log(p[np.arange(5), labels]).mean())

    (touched, grown), output, bias = q.gradients(model, batch, labels)
    before, step = mean_loss(), 1e-2
    model.vectors[touched] -= step * grown
    model.output -= (step * output).astype(np.float32)
    model.bias -= (step * bias).astype(np.float32)
    squared = float((grown**2).sum() + (output**2).sum() + (bias**2).sum())
    assert before - mean_loss() == pytest.approx(step * squared, rel=0.05)


def test_features_stand_for_what_they_should():
    """Equal features share a slot, wherever they are; as many as there are; few others collide."""
    slot_of, used = {}, {}
    rng = np.random.default_rng(0)
    many = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(60)) for _ in range(5)]
    for text in [*TEXTS, *many]:
        want = plain_features(text)
        got = np.concatenate([np.zeros(0, int), *q.text_slots(text)]).tolist()
        assert len(got) == len(want)
        if len(text.encode()) < q.BLOCK:
            for feature, slot in zip(want, got):
                assert slot_of.setdefault(feature, slot) == slot, feature
                used.setdefault(slot, set()).add(feature)
    assert slot_of["repeat", b""] == q.REPEAT
    assert sum(len(f) - 1 for f in used.values()) <= 3 + len(slot_of) ** 2 // q.SLOTS


def test_parts_give_the_same_features_and_scores(monkeypatch):
    model = q.Model(5)
    model.shift = 0.3
    scorer = q.scorer_of(model)
    for text in TEXTS:
        whole = sorted(np.concatenate([np.zeros(0, int), *q.text_slots(text)]).tolist())
        for size in (1, 7, 100):
            assert sorted(np.concatenate([np.zeros(0, int), *q.text_slots(text, size)]).tolist()) == whole
        logits = model.mean(q.features(text)) @ model.output + model.bias + np.array([0, model.shift])
        assert scorer.score(text) == pytest.approx(float(q.softmax(logits)[1]), abs=1e-5)


def docs_and_labels(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, quality string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")


def test_odd_inputs(spark):
    rows = [(i, f"fine words here number {i}", 1) for i in range(40)] + [(100 + i, f"bad!!! junk### {i}###", 0) for i in range(40)]
    rows += [(None, "nobody", 0), (500, None, 0), (501, "x" * 20_000, 0), (502, "label of another kind", 7), (503, "no label", None)]
    rows += [rows[0], rows[41]]
    docs, labels = docs_and_labels(spark, rows)
    sample, share = q.training_sample(docs, labels.unionAll(spark.createDataFrame([(999, 0)], labels.schema)))
    ids = {int(i) for i in sample["doc_id"]}
    assert not ids & {500, 501, 502, 503, 999} and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert len(sample) == len(ids) and 0.3 < share < 0.7
    model = q.fit(docs, labels)
    texts = spark.createDataFrame([(None,), ("",), (" \n",), ("fine words",), ("bad!!! junk###",), ("y " * 2_000_000,)], "text string")
    got = [r.s for r in texts.select(q.scores(F.col("text"), model, spark).alias("s")).collect()]
    assert got[0] == got[1] == got[2] and got[3] > 0.5 > got[4] and all(0 <= s <= 1 for s in got)


def test_one_label_or_none(spark):
    docs, labels = docs_and_labels(spark, [(i, "words", 1) for i in range(9)])
    assert q.fit(docs, labels).fixed == 1.0
    assert q.fit(docs, labels.where("false")).fixed == 0.5
    assert docs.where("false").select(q.scores(F.col("text"), q.fit(docs, labels), spark)).count() == 0


def test_the_bound_leaves_no_place_to_unusable_labels(spark):
    rows = [(i, None if i < 50 else f"text {i}", i % 2) for i in range(100)]
    docs, labels = docs_and_labels(spark, rows)
    sample, _ = q.training_sample(docs, labels, per_label=5)
    assert sorted(sample.groupby("quality").size()) == [5, 5]


def test_held_out_accuracy(spark):
    got = q.op11_quality_classifier(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").toPandas().drop_duplicates("doc_id")
    held = got[got["held_out"]].merge(labels, on="doc_id")
    good, junk = held[held["quality"] == 1], held[held["quality"] == 0]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"]]).all()
    assert good["predicted"].mean() > 0.99 and junk["predicted"].mean() < 0.03
