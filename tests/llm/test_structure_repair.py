"""Structure repair against a plain forward search, with chunks of many sizes, and against its SQL."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from logloom.llm import structure_repair as r
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\f\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's (turn, role, text) rows: the cheapest edits, by trying all of them forwards."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        kept = text.rstrip(BLANKS)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    # state: what was said last ("" nothing, s, u, a); value: cost, audit, said rows
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def insertions(table):
        for _ in range(3):
            for state, (cost, audit, said) in list(table.items()):
                to = follow[state]
                offer(table, to, (cost + 2, audit + "I", (*said, ({"u": "user", "a": "assistant"}[to], ""))))

    for (_, role, text), fault in zip(rows, faults):
        insertions(best)
        after = {}
        for state, (cost, audit, said) in best.items():
            offer(after, state, (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra, own, to = int(fault == "truncated"), role[:1], follow[state]
            if own == to or (own == "s" and state == ""):
                offer(after, own, (cost + extra, audit + "K", (*said, (role, text))))
            offer(after, to, (cost + 2 + extra, audit + "R", (*said, ({"u": "user", "a": "assistant"}[to], text))))
        best = after
    insertions(best)
    cost, audit, said = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest(),
    }


def found(spark, rows, size, passes):
    numbered = r.number_rows(spark.createDataFrame(rows, SCHEMA))
    edits = r.find_edits(numbered, size, passes)
    digests = r.repaired(numbered, edits, size).mapInPandas(r._digest, "conv bigint, lone boolean, digest string")
    audits = {}
    for e in sorted(edits.collect(), key=lambda e: (e.lone, e.conv, e.chunk)):
        own = audits.setdefault(None if e.lone else e.conv, {"cost": 0, "audit": "", "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
        for name in own:
            own[name] += e[name]
    for d in digests.collect():
        audits[None if d.lone else d.conv]["repaired_sha256"] = d.digest
    return audits


def random_rows(seed, conversations=60):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        own = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool"], ["tool"], ["user"], ["assistant", "assistant", ""]])
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            text = rng.choice(["yes.", "no!", "cut off", "same?", "", " \n", f"t{rng.random()}.", f"t{rng.random()}", f"t{turn}. \t"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3]), rng.choice([*own, None] if conv % 9 == 0 else own), text))
    return rows


@pytest.mark.parametrize("size, passes", [(1024, 4), (1, 4), (2, 0), (3, 1), (4, 50)])
def test_edits_equal_a_plain_search(spark, size, passes):
    rows = random_rows(size)
    got = found(spark, rows, size, passes)
    by_conv = {}
    for conv, turn, role, text in rows:
        fill = lambda x: " " if x is None else x
        by_conv.setdefault(conv, []).append((turn, fill(role), fill(text)))
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        want = plain_repair(own)
        want.pop("gaps")
        assert {**got[conv], "repaired_sha256": got[conv].get("repaired_sha256", r.EMPTY_HASH)} == want, (conv, own)


def test_rank_convergence_and_stitching_agree(spark):
    """Rows that fit no role never converge; rows of legal order do at once."""
    odd = [(1, i, "tool", f"x{i}.") for i in range(201)]
    even = [(2, i, ["user", "assistant"][i % 2], f"x{i}.") for i in range(200)]
    blank = [(3, i, "user", "") for i in range(100)] + [(3, 100, "assistant", "end.")]
    rows = odd + even + blank
    one = found(spark, rows, 1024, 4)
    assert found(spark, rows, 7, 2) == one == found(spark, rows, 7, 0)
    assert one[2]["audit"] == "K" * 200 and one[3]["audit"] == "D" * 100 + "IK" and one[3]["cost"] == 302


def test_the_query_equals_brute_force(spark, tmp_path):
    rows = [x for x in random_rows(99, 80)] + [(1000 + i, i, "user", None) for i in range(3)]
    rows += [(7000, t, "user", "gone.") for t in range(5000) if zlib.crc32(f"7000:{t}".encode()) % 20 == 0][:2]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("clash")).withColumn("lone", F.lit(1)).withColumn("pos", F.lit(2))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x["conv_id"]: x.asDict() for x in r.op13_structure_repair(spark, str(tmp_path)).collect()}
    by_conv = {x[0]: [] for x in rows}
    for conv, *own in plain_damage(rows):
        by_conv[conv].append(tuple(own))
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        assert {k: got[conv][k] for k in COLUMNS} == plain_repair(own), conv
    assert got[7000]["audit"] == "" and got[7000]["repaired_sha256"] == r.EMPTY_HASH


def test_long_texts_and_an_empty_table(spark, tmp_path):
    big = "y" * 3_000_000
    got = found(spark, [(1, 0, "user", big + "."), (1, 1, "assistant", big), (1, 2, "assistant", big)], 1024, 4)[1]
    want = plain_repair([(0, "user", big + "."), (1, "assistant", big), (2, "assistant", big)])
    assert got == {k: v for k, v in want.items() if k != "gaps"}
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert r.op13_structure_repair(spark, str(tmp_path)).count() == 0
