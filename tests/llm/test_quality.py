"""Counts against plain counting; sketches, thresholds and verdicts."""

import random
import re

import numpy as np
import pytest
from logloom.llm import quality as q
from logloom.llm.common import table
from pyspark.sql import functions as F

SPLIT = re.compile("[\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = [w for w in SPLIT.split(text) if w]
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if SPLIT.sub("", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered), sum("A" <= c <= "Z" for c in text)
    )


TEXTS = ["", None, " \n ", "a", "x\n\nx\n x\nx", "é|# <b> & *", "a b c d e f g h " * 4, "q " * 30, "A\x0bB\x0cC\xa0d e", "one two three\r\none two three\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert q.text_counts(text or "") == plain_counts(text)


def test_counts_of_documents(spark):
    rng = random.Random(1)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if len(r.text) < 6000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for text in texts:
        assert q.text_counts(text) == plain_counts(text)


def test_sketch_quantiles_are_accurate_and_mergeable(spark):
    rng = np.random.default_rng(2)
    values = [(int(i % 3), float(v)) for i, v in enumerate(np.concatenate([rng.lognormal(-2, 1, 3000), np.zeros(500)]))]
    frame = spark.createDataFrame(values, "g int, value double").withColumn("rate", F.lit("r"))
    shares = {"a": 0.1, "b": 0.5, "c": 0.95}
    whole = q.quantiles(q.sketches(frame, []), [], shares).first()
    parts = q.quantiles(q.merged(q.sketches(frame, ["g"]), []), [], shares).first()
    assert whole["split"] is not None
    assert whole == parts and whole["size"] == len(values)
    ordered = np.sort([v for _, v in values])
    for name, share in shares.items():
        exact = ordered[int(np.ceil(share * len(ordered))) - 1]
        assert abs(whole[name] - exact) <= 1.01 * q.ACCURACY * exact + q.SMALLEST


def test_verdicts(spark):
    word = "abcdef"
    good = lambda i: " ".join(f"{word[(i * k) % 6:]}{i}x{k}" for k in range(1, 60))
    rows = [(i, good(i), "en", "s", 1) for i in range(300)]
    rows += [(1000, " | ".join(f"w{k}x" for k in range(50)), "en", "s", 1), (1001, good(3).upper(), "en", "s", 1), (1002, "short", "en", "s", 1)]
    rows += [(1003, "a b c d e f g h " * 10, "en", "s", 1), (1004, None, None, None, 1), (1005, good(1), "xx", None, 1), (1005, good(1), "xx", None, 1)]
    rows += [(None, good(2), "en", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept int")
    got = [(r.doc_id, r.base_failed, r.kept) for r in q.judge(frame).collect()]
    assert len(got) == len(rows)
    verdict = {i: (b, k) for i, b, k in got}
    assert all(verdict[i] == (False, True) for i in list(range(300)) + [1005, None])
    assert verdict[1000] == (False, False) and verdict[1001] == (False, False)
    assert verdict[1002] == (True, False) and verdict[1003] == (True, False) and verdict[1004] == (True, False)
    assert q.judge(frame.limit(0)).count() == 0


def test_kept_against_labels(spark):
    """Rows labelled as junk are mostly dropped, hardly any other."""
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    judged = q.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    good, junk = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.98
    assert (~junk.kept).mean() > 0.5


def test_limits_follow_the_spread_of_their_group(spark):
    """The same rate is an outlier in an even group and ordinary in a varied one."""
    even, varied = [(0.1 + i % 10 / 1000) for i in range(300)], [(0.1 + i % 100 / 1000) for i in range(300)]
    rows = [(s, r, v) for s, values in (("even", even), ("varied", varied)) for v in values for r in ("upper_rate", "repeat_rate")]
    rows += [("even", "long_words", 5.0 + v) for v in even] + [("varied", "long_words", 5.0 + 10 * v) for v in varied]
    frame = spark.createDataFrame([("en", *r) for r in rows], "lang string, source string, rate string, value double")
    got = {r.source: r.limits for r in q.thresholds(q.sketches(frame, ["lang", "source"])).collect()}
    for rate in ("upper_rate", "repeat_rate", "long_words"):
        assert got["varied"][rate] > 1.2 * got["even"][rate]


def test_floors_only_serve_where_there_is_no_spread(spark):
    counts = q.measured(table(spark, "/root/testdata/sf0.1", "documents"), ["doc_id", "lang", "source"]).where(~q.base_failed())
    listed = counts.select("lang", "source", F.explode(F.create_map(*[x for k, v in q.rates().items() for x in (F.lit(k), v)])).alias("rate", "value"))
    limits = q.thresholds(q.sketches(listed, ["lang", "source"])).select("limits").collect()
    for rate in ("upper_rate", "dup_line_rate", "repeat_rate", "long_words", "short_words"):
        assert len({r.limits[rate] for r in limits}) > 1


def plain_split(values):
    """The first value above the best of all cuts, and its bucket's lower end."""
    step = np.log(q._gamma())
    bucket = np.ceil(np.log(np.maximum(values, q.SMALLEST)) / step).astype(int)
    place = np.maximum(bucket, int(np.ceil(np.log(q.ABSENT) / step)))
    best = (0.0, None)
    for cut in sorted(set(bucket))[1:]:
        low, high = place[bucket < cut], place[bucket >= cut]
        v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
        if v > best[0] * (1 + 1e-12):
            best = (v, cut)
    return None if best[1] is None else q._gamma() ** (best[1] - 1)


@pytest.mark.parametrize("seed", range(4))
def test_split_against_all_cuts(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.zeros(200), rng.lognormal(-5, 0.6, 20 * seed), rng.lognormal(-1.5, 0.3, 30)])
    frame = spark.createDataFrame([(float(v), "symbol_rate") for v in values], "value double, rate string")
    got = q.quantiles(q.sketches(frame, []), [], {"q50": 0.5}).first()["split"]
    assert got == pytest.approx(plain_split(values))
    # The far part is above the limit, the near one below it but for the tail of its spread.
    assert (values[-30:] > got).all() and (values[:-30] <= got).mean() > 0.98
    same = q.quantiles(q.sketches(frame.where("value = 0"), []), [], {"q50": 0.5}).first()
    assert same["split"] is None


def test_no_floor_decides_the_symbols(spark):
    counts = q.measured(table(spark, "/root/testdata/sf0.1", "documents"), ["doc_id", "lang", "source"]).where(~q.base_failed())
    listed = counts.select("lang", "source", F.lit("symbol_rate").alias("rate"), q.rates()["symbol_rate"].alias("value"))
    limits = [r.limits["symbol_rate"] for r in q.thresholds(q.sketches(listed, ["lang", "source"])).collect()]
    assert len(set(limits)) > 1 and min(limits) > q.FLOORS["symbol_rate"]
