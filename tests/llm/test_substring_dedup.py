"""Repeated word windows against counting all of them."""

import random
from collections import Counter

import numpy as np
import pytest
from logloom.llm import substring_dedup as d
from logloom.llm.common import table


def brute(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def frame_of(spark, docs):
    return spark.createDataFrame([(a, b, "x", 3) for a, b in docs], "doc_id bigint, text string, kept string, n_words int").repartition(6)


def made_up(rng, n=120):
    passages = [" ".join(rng.choice("abcdef") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"{rng.randint(0, 999)}é" for _ in range(rng.randint(0, 30))))
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, "ab " * 60), (n + 3, "x y z " * 30), (n + 4, docs[0][1]), (0, docs[0][1]), (None, passages[0]), (None, None)]
    return docs


@pytest.mark.parametrize("window,run,heavy", [(6, 3, 2000), (6, 3, 1), (9, 8, 3), (5, 5, 2)])
def test_every_repeat_and_nothing_else(spark, window, run, heavy):
    docs = made_up(random.Random(window + heavy))
    got = sorted((tuple(r) for r in d.dedup_substrings(frame_of(spark, docs), window=window, run=run, heavy=heavy).collect()), key=str)
    assert got == brute(docs, window)


def test_stretches(spark, monkeypatch):
    words = [str(i % 700).encode() for i in range(2500)]
    whole = d._text_super_kmers(words, 10, 4)
    monkeypatch.setattr(d, "STRETCH", 100)
    cut = d._text_super_kmers(words, 10, 4)
    cover = lambda found: Counter(int(f) + k for f, n in zip(found[1], found[2]) for k in range(n))
    assert cover(whole) == cover(cut) == Counter(range(len(words) - 9))
    minimiser = lambda found: {int(f) + k: int(m) for m, f, n in zip(*found) for k in range(n)}
    assert minimiser(whole) == minimiser(cut)


def test_equal_windows_have_equal_minimisers():
    rng = np.random.default_rng(0)
    words = [str(x).encode() for x in rng.integers(0, 3, 400)]
    for window, run in ((7, 3), (12, 5), (8, 8)):
        minimiser, first, count = d.super_kmers(d.word_hashes(words), window, run)
        of = {int(f) + k: (int(m), i) for i, (m, f, n) in enumerate(zip(minimiser, first, count)) for k in range(n)}
        seen = {}
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                assert of[i][0] == of[seen[key]][0] and of[i][1] != of[seen[key]][1]
            seen[key] = i


def test_empty_tables(spark):
    assert d.dedup_substrings(frame_of(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in d.dedup_substrings(frame_of(spark, [(1, None)])).collect()] == [(1, 0, 0, "")]


def test_query_on_the_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    import hashlib

    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(docs, d.WINDOW)]
    assert sorted((tuple(r) for r in d.op5_substring_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == sorted(want, key=str)
