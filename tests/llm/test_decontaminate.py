"""Leaks against brute force over every item-sized window."""

import random
import re
from collections import Counter

import pytest
from logloom.llm import decontaminate as d
from logloom.llm.common import table


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def brute(docs, items, threshold=0.8):
    found = {}
    for doc, text in docs:
        words = words_of(text)
        for item, item_text in items:
            passage = words_of(item_text)
            if not passage:
                continue
            width, n = min(5, len(passage)), len(passage)
            own = grams(passage, width)
            best = 0.0
            for s in range(1 - n, len(words)):
                best = max(best, jaccard(grams(words[max(s, 0) : s + n], width), own))
            if best >= threshold:
                found[doc, item] = max(found.get((doc, item), 0.0), best)
    return found


def made_up(rng, vocabulary=40):
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, vocabulary))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 15, 30, 60])))) for i in range(25)]
    items += [(25, "the same the same the same the same the same the same the same"), (26, None), (27, "  ... "), (28, "")]
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            passage = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                if passage:
                    at = rng.randrange(len(passage))
                    kind = rng.random()
                    if kind < 0.4:
                        passage[at] = word()
                    elif kind < 0.6:
                        del passage[at]
                    elif kind < 0.8:
                        passage.insert(at, word())
                    else:
                        passage = passage[at:] + passage[:at]
            at = rng.choice([0, len(words), rng.randint(0, len(words))])
            words[at:at] = passage
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).title() if rng.random() < 0.5 else " ".join(words)))
    return docs + [(150, None), (151, ""), (152, items[3][1]), (152, items[3][1]), (None, items[4][1])], items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_every_leak_is_found(spark, monkeypatch, broadcast):
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", broadcast)
    docs, items = made_up(random.Random(5))
    docs_df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item_id string")
    items_df = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(docs_df, items_df).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 40 and any(v < 1 for v in want.values())


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs, items = made_up(random.Random(6))
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id bigint, text string, __leaked string, similarity int")
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    kept = d.decontaminate(frame, items_df)
    assert kept.columns == frame.columns
    leaked_texts = {docs[i][1] for i in range(len(docs)) if brute([docs[i]], items)}
    assert sorted(map(str, ((r[0], r[1]) for r in kept.collect()))) == sorted(str(x) for x in docs if x[1] not in leaked_texts)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    assert d.find_leaks(docs, items).count() == 0
    assert d.find_leaks(some, items).count() == 0
    assert d.find_leaks(docs, some.toDF("item_id", "text")).count() == 0
    assert d.decontaminate(some, items).count() == 1


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(1)
    for radius in (3, 24):
        pairs = []
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
        frame = spark.createDataFrame(pairs, "a bigint, b bigint")
        from pyspark.sql import functions as F

        blocks = frame.select(d.hamming_blocks(F.col("a"), radius).alias("a"), d.hamming_blocks(F.col("b"), radius).alias("b"))
        assert blocks.where(~F.arrays_overlap("a", "b")).count() == 0


def test_native_plan_and_query(spark):
    found = d.op1_decontaminate(spark, "/root/testdata/sf0.001")
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    shingles = {g for _, t in items for g in grams(words_of(t), min(5, len(words_of(t)) or 1))}
    near = [x for x in docs if any(g in shingles for g in grams(words_of(x[1]), 5))]
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(near, items).keys()
