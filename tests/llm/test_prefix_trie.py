"""The prefix trie against one built by hand, with segments, shards and ranges of many sizes."""

import random
import zlib
from hashlib import sha256

import pytest
from logloom.llm import prefix_trie as p
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_rebuild(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + (-c) % 100
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(paths):
    """{conversation: turns} to the rows of all nodes."""
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        below = [sums[k] for k in kids.get(path, [])]
        sums[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for path, members in nodes.items():
        ended = sorted(c for c in members if len(paths[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), *sums[path],
            sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df):
    assert df.columns == p.NODE_COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def random_rows(seed, convs=150):
    rng, rows = random.Random(seed), []
    starts = [[("system", f"s{i}")] * 1 + [("user", f"u{i}-{j}") for j in range(rng.choice([0, 2, 9]))] for i in range(3)]
    for _ in range(convs):
        c = rng.choice([rng.randrange(0, 400), rng.randrange(-150, 0), rng.randrange(0, 5) * 100])
        turns = list(rng.choice(starts)) if rng.random() < 0.7 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["same", "a" * rng.randrange(5), None, f"x{rng.randrange(3)}"])) for _ in range(rng.choice([0, 1, 1, 4, 12]))]
        rows += [(c, rng.choice([i, i, i, None]) if c % 7 == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("segment, shard, hot, block", [(16, 50_000, 1000, 4096), (1, 3, 5, 2), (2, 1, 2, 3), (3, 7, 50, 4)])
def test_nodes_equal_a_plain_trie(spark, monkeypatch, segment, shard, hot, block):
    for name, value in (("SEGMENT", segment), ("SHARD_ITEMS", shard), ("HOT", hot), ("BLOCK", block)):
        monkeypatch.setattr(p, name, value)
    rows = random_rows(segment + shard)
    turns = p.number_turns(spark.createDataFrame(rows, SCHEMA))
    want = plain_trie(plain_rebuild(rows))
    assert found(p.prefix_trie(*p.rebuilt(turns))) == want


def test_copies_chains_and_deep_shared_starts(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD_ITEMS", 4)
    deep = [("user", f"d{i}") for i in range(50)]
    paths = {i: deep + [("user", f"own{i}")] * (i % 3) for i in range(6)}
    paths |= {100 + i: [("user", "copy"), ("assistant", "c" * i)] for i in [5] * 9 for i in range(i)}
    paths |= {200: [("user", f"long{i}") for i in range(300)], 201: [("user", f"long{i}") for i in range(300)], 202: [], 203: deep[:17]}
    rows = [(c, i + 1, f"{r}:{t}".encode(), len(t)) for c, turns in paths.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame([(c, d, bytearray(x), n) for c, d, x, n in rows], "conv bigint, depth bigint, digest binary, chars int")
    convs = spark.createDataFrame([(c, len(t)) for c, t in paths.items()], "conv bigint, len bigint")
    assert found(p.prefix_trie(turns, convs)) == plain_trie(paths)


def test_the_search_tree_is_balanced():
    paths = [[i] for i in range(1023)]
    tree = p.build(paths)
    depth = {tree.top: 1}
    for i in range(len(tree.key)):
        for child in (tree.less[i], tree.more[i]):
            if child >= 0:
                depth[child] = depth[i] + 1
    assert max(depth.values()) == 10 and all(up < i for i, up in enumerate(tree.up))


def test_the_query_on_odd_rows(spark, tmp_path):
    rows = random_rows(5, 40) + [(None, 1, "user", "nobody"), (9, 0, "user", "z" * 2_000_000), (9, 0, "user", "z" * 2_000_000)]
    rows += [(777, i, "user", f"n{i}") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("clash")).withColumn("depth", F.lit(1)).withColumn("n", F.lit(2))
    df.write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    assert found(p.op12_prefix_trie(spark, str(tmp_path / "a"))) == plain_trie(plain_rebuild(rows))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b" / "conversations.parquet"))
    assert p.op12_prefix_trie(spark, str(tmp_path / "b")).count() == 0
    only_short = [(c, 0, "user", "x") for c in range(1, 9) if zlib.crc32(str(c).encode()) % 6 > 0]
    spark.createDataFrame(only_short, SCHEMA).write.parquet(str(tmp_path / "c" / "conversations.parquet"))
    assert found(p.op12_prefix_trie(spark, str(tmp_path / "c"))) == plain_trie(plain_rebuild(only_short))
