"""The skew-safe forms must equal the plain window, also on one huge key."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators.ordering import exact_percentile, exact_percentiles, next_event, position, rank_descending, time_bucket


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key; times repeat and some are missing."""
    n = spark.range(6000).withColumn("h", F.xxhash64("id"))
    return n.select(
        F.when(F.col("h") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.abs("h") % 40).cast("string"))).alias("k"),
        F.when(F.col("id") % 97 != 0, F.timestamp_seconds(1704067200 + F.abs("h") % 200000)).alias("ts"),
        F.col("id"),
        F.when(F.col("id") % 11 != 0, F.round((F.abs("h") % 900) / 7, 2)).alias("v"),
    )


def test_position_equals_row_number(skewed):
    order = [F.col("ts").asc_nulls_last(), F.col("id").asc()]
    got = position(skewed, ["k"], order, time_bucket(F.col("ts")), "p")
    plain = skewed.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert got.columns == plain.columns
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_rank_equals_plain_rank(skewed):
    got = rank_descending(skewed, "v", "r")
    plain = skewed.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())).cast("bigint"))
    assert got.select(plain.columns).exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_rank_of_a_constant(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(10)], "i int, v double")
    assert {r["r"] for r in rank_descending(df, "v", "r").collect()} == {1}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_percentile_equals_builtin(skewed, p):
    got = {r["k"]: r["x"] for r in exact_percentile(skewed, ["k"], "v", p, "x").collect()}
    want = {r["k"]: r["x"] for r in skewed.groupBy("k").agg(F.percentile("v", p).alias("x")).collect()}
    assert got.keys() == {k for k, x in want.items() if x is not None}
    for k, x in got.items():
        assert x == pytest.approx(want[k], abs=1e-9)


def test_percentile_without_keys_and_stacked(skewed):
    want = skewed.agg(F.percentile("v", 0.8).alias("x")).first()["x"]
    assert exact_percentile(skewed, [], "v", 0.8, "x").first()["x"] == pytest.approx(want)
    both = exact_percentiles(skewed.withColumn("w", F.col("v") * 2), ["k"], ["v", "w"], 0.5)
    for r in both.collect():
        assert r["w"] == pytest.approx(2 * r["v"])


def test_percentile_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "k string, v double")
    assert [tuple(r) for r in exact_percentile(df, ["k"], "v", 0.5, "x").collect()] == [(None, 2.0)]
    assert exact_percentile(df.limit(0), ["k"], "v", 0.5, "x").count() == 0


def test_percentiles_of_odd_numbers(spark):
    """Signs, zeros, far values, ties and values within one digit, against the plain function."""
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", None):
        for _ in range(200):
            x = rng.choice([0.0, -0.0, 5e-324, -1e300, 1e300, float("inf"), -2.5, 1.0, rng.random(), 1 + rng.random() / 1e6, -rng.random() * 1e9])
            rows.append((key, x))
    df = spark.createDataFrame(rows + [("c", None), ("d", float("inf")), ("e", float("-inf")), ("f", 7.0)], "k string, x double")
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {r["k"]: r["p"] for r in df.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", F.lit(p)).alias("p")).collect()}
        got = {r["k"]: r["p"] for r in exact_percentile(df, ["k"], "x", p, "p").collect()}
        assert got.keys() == want.keys()
        for k in got:
            assert got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True), (k, p)


@pytest.mark.parametrize("unit", ["minute", "day"])
def test_next_event_equals_a_search_over_all_events(spark, unit):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)

    def times(n):
        return [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *[start + timedelta(seconds=rng.randrange(0, 9000, 30)) for _ in range(6)]])) for _ in range(n)]

    asked, events = times(300), times(40)
    rows = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(asked)], "id int, k string, t timestamp, carried string")
    seen = spark.createDataFrame(events, "k string, t timestamp")
    got = {r["id"]: r["next"] for r in next_event(rows, seen, "k", "t", "next", unit).collect()}
    want = {}
    for i, (k, t) in enumerate(asked):
        later = [e for ek, e in events if k is not None and ek == k and t is not None and e is not None and e >= t]
        want[i] = min(later, default=None)
    assert got == want
    assert any(want.values()) and next_event(rows, seen.limit(0), "k", "t", "next").where("next is not null").count() == 0
    assert next_event(rows.limit(0), seen, "k", "t", "next").columns == ["id", "k", "t", "carried", "next"]


def test_next_event_shuffles_the_wide_rows_once(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1), "text")], "k string, t timestamp, text string")
    with_off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_off}
    for k, v in with_off.items():
        spark.conf.set(k, v)
    try:
        query = next_event(rows, rows.select("k", "t"), "k", "t", "next")._jdf.queryExecution()
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sum("text#" in columns for columns in exchanged) == 1
