"""The classifier: gradients, scoring in blocks, odd inputs, held-out accuracy."""

import zlib

import numpy as np
import pytest
from logloom.llm import toxicity as t
from logloom.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def small_model():
    return t.Model(3)


def loss_of(model, slots, labels):
    scorer = t.Scorer(model)
    logits = np.array([t._logit(scorer, s) for s in slots])
    p = 1 / (1 + np.exp(-logits))
    return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())


def test_gradients_follow_the_loss():
    model, reader = small_model(), t.WordSlots()
    slots = [reader.of(x) for x in ("a b c d e", "one", "", "the quick brown fox jumps", "b c")]
    labels = np.array([1, 0, 1, 0, 1], np.float32)
    gradients, constant = t._batch_gradients(model, slots, labels)
    step = 1e-3
    before = loss_of(model, slots, labels)
    for p, g in zip(model.parameters(), gradients):
        rows, g = g if isinstance(g, tuple) else (slice(None), g)
        p[rows] -= step * g
    model.constant -= np.float32(step * constant)
    squared = constant**2 + sum(float(((g[1] if isinstance(g, tuple) else g) ** 2).sum()) for g in gradients)
    fall = before - loss_of(model, slots, labels)
    assert fall == pytest.approx(step * squared, rel=0.05)


def test_blocks_give_the_same_score(monkeypatch):
    scorer = t.Scorer(small_model())
    rng = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in rng.integers(0, 500, 3000))
    whole = scorer.logit(text)
    monkeypatch.setattr(t, "BLOCK", 7)
    assert scorer.logit(text) == whole


def test_scores_of_odd_texts(spark):
    model = small_model()
    rows = [(None,), ("",), ("...",), ("word",), ("x " * 200_000,), ("é\x00\n",)]
    got = [r.s for r in spark.createDataFrame(rows, "text string").select(t.scores(F.col("text"), model, spark).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1] == got[2]


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, x, "en", 1.0) for i, x, _ in rows], "doc_id bigint, text string, lang string, score double")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")


def test_no_labels_or_one_class(spark):
    for y in (None, 0, 1):
        docs, labels = labelled(spark, [(i, f"text {i}", y) for i in range(12)] + [(None, None, y), (3, "again", y)])
        model, thresholds = t.fit(docs, labels)
        assert model.fixed == (0.49 if y == 1 else 0.0) and thresholds == {"": 0.5}
        assert t.drop_toxic(docs, labels).columns == docs.columns
        assert t.drop_toxic(docs, labels).count() == docs.count()
        assert t.drop_toxic(docs.limit(0), labels).count() == 0


def test_sample_leaves_out_the_held_rows(spark):
    docs, labels = labelled(spark, [(i, f"text {i}", i % 2) for i in range(200)])
    sample, share = t.training_sample(docs, labels, per_class=30)
    assert len(sample) <= 60 and not [i for i in sample["doc_id"] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert 0.3 < share < 0.7


def test_labels_without_usable_texts_leave_the_sample_whole(spark):
    docs, labels = labelled(spark, [(i, None if i < 100 else "x" * 50 if i < 150 else f"text {i}", i % 2) for i in range(200)])
    labels = labels.unionAll(labels.selectExpr("doc_id + 1000", "toxic"))
    sample, _ = t.training_sample(docs, labels, per_class=15, max_bytes=20)
    assert sorted(sample.groupby("toxic").size()) == [15, 15] and sample["doc_id"].between(150, 199).all()


def test_one_scoring_pass_gives_the_calibrated_scores(spark):
    rows = [(i, f"vile word{i % 7}" if i % 3 == 0 else f"kind word{i % 11}", int(i % 3 == 0)) for i in range(150)] + [(None, None, 0)]
    docs, labels = labelled(spark, rows)
    model, thresholds = t.fit(docs, labels)
    once, same = t.fit_and_score(docs, labels, docs.columns, "__score")
    twice = docs.withColumn("__score", t.scores(F.col("text"), model, spark))
    key = lambda df: sorted((r.doc_id or -1, round(r["__score"], 9)) for r in df.collect())
    assert key(once) == key(twice) and same == thresholds


def test_thresholds_come_from_all_labelled_rows(spark):
    """A language whose toxic rows are few, and all too long for the sample, gets its own threshold."""
    rows = [(i, f"vile word{i % 7}" if i % 3 == 0 else f"kind word{i % 11}", "en", int(i % 3 == 0)) for i in range(300)]
    long = "mot " * (t.SAMPLE_BYTES // 4)
    rows += [(1000 + i, long + ("vile" if i % 3 == 0 else "kind"), "fr", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    model, thresholds = t.fit(docs, labels)
    assert set(thresholds) == {"", "en", "fr"} and thresholds[""] == 0.5
    counted = t.logit_histogram(docs, labels, model)
    assert counted.n.sum() == sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    assert t.drop_toxic(docs, labels).where("lang = 'fr'").count() == 80


def test_score_does_not_know_the_language(spark):
    model = small_model()
    docs = spark.createDataFrame([("same words", "en"), ("same words", "fr"), ("same words", None)], "text string, lang string")
    scored = docs.withColumn("s", t.scores(F.col("text"), model, spark))
    assert scored.select("s").distinct().count() == 1
    flagged = scored.select(t.toxic_by_language(F.col("s"), F.col("lang"), {"": 0.0, "fr": 2.0}).alias("f"), "lang").collect()
    assert {r.lang: r.f for r in flagged} == {"en": True, "fr": False, None: True}


def test_held_out_accuracy(spark):
    truth = table(spark, SF, "labels").select("doc_id", "toxic")
    scored = t.op6_toxicity(spark, SF)
    assert scored.count() == table(spark, SF, "documents").count()
    held = scored.join(truth, "doc_id").where("held_out").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (clean.predicted == 0).mean() >= 0.98
    assert (toxic.predicted == 1).mean() >= 0.85
    pairs = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None]).mean()
    assert pairs >= 0.95
