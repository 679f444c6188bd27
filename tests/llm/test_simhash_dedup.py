"""Fingerprints bit by bit, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from logloom.llm import simhash_dedup as d
from logloom.llm.common import table
from pyspark.sql import functions as F
from logloom.llm.components import _toward_minimum, connected_components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, errors):
    values = sorted(set(values))
    of = {v: v for v in values}

    def root(v):
        while of[v] != v:
            v = of[v]
        return v

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= errors):
            a, b = root(v), root(values[i + 1 + int(j)])
            of[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "A b C", "a b c d", "A\x0bB\x0cC d\xa0e F É ü", "the same the same the same the same the same", "x " * 5000,
])
def test_fingerprint(text):
    assert d.fingerprint(text or "") == plain_fingerprint(text)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def values_of(rng, n, clusters, size, spread):
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(size):
            v = centre
            for bit in rng.sample(range(64), rng.randint(0, spread)):
                v ^= 1 << bit
            values.append(v)
    # a chain in which neighbours differ by four bits
    v = rng.getrandbits(64)
    for _ in range(40):
        values.append(v)
        for bit in rng.sample(range(64), 4):
            v ^= 1 << bit
    return values + [0, (1 << 64) - 1, 1, 15, 31, 1 << 63]


@pytest.mark.parametrize("errors", [0, 1, 3, 4, 6])
@pytest.mark.parametrize("part_leaves", [20_000, 5])
def test_components_of_fingerprints(spark, monkeypatch, errors, part_leaves):
    monkeypatch.setattr(d, "DIRECT_PAIRS", 4)
    values = values_of(random.Random(errors), 1500, 8, 60, 5)
    rows = [(i, signed(v)) for i, v in enumerate(values)] + [(7, signed(values[9])), (None, signed(values[3])), (None, signed(values[0] ^ 1))]
    frame = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint").repartition(5)
    got = {r.fingerprint: r.component_id for r in d.near_components(frame, errors, part_leaves).collect()}
    roots = plain_components([v % (1 << 64) for _, v in rows], errors)
    least = {}
    for i, v in rows:
        if i is not None:
            r = roots[v % (1 << 64)]
            least[r] = min(least.get(r, i), i)
    assert got == {v: least.get(roots[v % (1 << 64)]) for _, v in rows}


def test_walk_keeps_memory_bounds(monkeypatch):
    monkeypatch.setattr(d, "WALK_PAIRS", 50)
    values = np.sort(np.array(sorted({v for v in values_of(random.Random(9), 300, 3, 100, 3)}), np.uint64))
    forest = d.Forest(len(values))
    d.walk(values, np.array([[0, len(values), 0, len(values)]]), 0, np.full(65, 4), 4, forest)
    roots = plain_components([int(v) for v in values], 4)
    got = {int(v): int(values[forest.labels[i]]) for i, v in enumerate(values)}
    assert got == roots
    assert len(forest.links) < len(values)


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200, 330)] + [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(5, 5), (None, 3), (3, None)]
    of = {i: i for pair in links if None not in pair for i in pair}
    for _ in range(400):
        for a, b in links:
            if a is not None and b is not None:
                of[a] = of[b] = min(of[a], of[b])
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {k: v for k, v in of.items() if k != v}
    assert connected_components(frame.limit(0)).count() == 0


def documents(spark, docs):
    return spark.createDataFrame([(i, t, "f", 1) for i, t in docs], "doc_id bigint, text string, fingerprint string, component_id int")


DOCS = [(3, "a b c d e f"), (2, "A B C D E F"), (9, None), (8, ""), (None, "a b c d e f"), (None, "only null"), (None, "only null"), (5, "x y"), (5, "x y"), (6, "p q r s t")]


def test_rows_and_clashes(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in d.near_duplicates(documents(spark, DOCS)).collect()), key=str)
    roots = plain_components([plain_fingerprint(t) for _, t in DOCS], 4)
    least = {}
    for i, t in DOCS:
        r = roots[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{plain_fingerprint(t):016x}", least.get(roots[plain_fingerprint(t)])) for i, t in DOCS]
    assert got == sorted(want, key=str)
    assert d.near_duplicates(documents(spark, DOCS).limit(0)).count() == 0


def test_keep_one(spark):
    kept = d.keep_one(documents(spark, DOCS))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A B C D E F"), (8, ""), (None, "only null"), (5, "x y"), (6, "p q r s t")], key=str)
    assert d.keep_one(documents(spark, DOCS).limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots = plain_components(prints.values(), 4)
    least = {}
    for i, v in prints.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in d.op7_simhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{v:016x}", least[roots[v]]) for i, v in prints.items()}


@pytest.mark.parametrize("both_ways", [True, False])
def test_the_centre_of_a_star_is_split_over_tasks(spark, both_ways):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # A star of 60,000 links, seen from its centre: the centre is the largest node for the small star.
        far = spark.range(1, 60_001, 1, 8).select(F.col("id").alias("leaf"), F.lit(0 if both_ways else 70_000).alias("centre").cast("long"))
        near = spark.range(100_000, 100_400, 1, 8).select(F.col("id").alias("leaf"), (F.col("id") + 1000).alias("centre"))
        ends = far.unionAll(near)
        links = ends.select(F.greatest("leaf", "centre").alias("a"), F.least("leaf", "centre").alias("b"))
        moved = _toward_minimum(links, both_ways)
        rows = moved.collect()
        plan = moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert len({r.a for r in rows}) >= 60_000
