"""The lake as a whole: rebuilds after late and replaced chunks, stream and batch on one tier, months, scrub of everything."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from logloom.plans import jobs, lifecycle
from logloom.schemas import ROLLUP_COLUMNS, TURN_COLUMNS, WIDE_COLUMNS
from logloom.sources import chunk_index as ci
from logloom.sources import providers, raw, tiers
from logloom.streaming import streams


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """The jobs are many and the rows few."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def req(rid, ts, sid="s1", **more):
    return json.dumps({"timestamp": ts, "type": "request", "request_id": rid, "session_id": sid, "origin": "https://a.example.org", "model": "m", **more})


def resp(rid, ts, **more):
    return json.dumps({"timestamp": ts, "type": "response", "request_id": rid, "latency_ms": 5, "content": "fine", **more})


def put(folder, day, name, lines):
    (folder / day).mkdir(parents=True, exist_ok=True)
    (folder / day / f"{name}-00-05-h-1-aa.jsonl").write_text("\n".join(lines) + "\n")


def plain(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def state(spark, root, scopes=("day", "month")):
    """All rows of a lake, tier by tier."""
    out = {"consolidated": plain(jobs.read_history(spark, root, "consolidated"), [*WIDE_COLUMNS, "log_date"])}
    for scope in scopes:
        grain = tiers.GRAINS[scope]
        for tier, columns in (("sessions", TURN_COLUMNS), ("session-rollup", ROLLUP_COLUMNS)):
            path = tiers.grain_path(root, tier, scope)
            out[tier, grain] = plain(spark.read.parquet(path), [*columns, "log_date"]) if ci.days_in(spark, path) else []
    return out


def built_at_once(spark, src, root):
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    jobs.rebuild(spark, root, "month")
    return state(spark, root)


def test_rebuild_after_a_late_record_equals_a_build_from_nothing(spark, tmp_path):
    """A later chunk brings the record of the day before the session's start: the session moves, it is not doubled."""
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z"), resp("a", "2024-01-05T09:00:01Z")])
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    jobs.rebuild(spark, root, "month")
    put(src, "2024-01-06", "00", [req("b", "2024-01-04T23:59:00Z"), req("c", "2024-01-06T00:00:00Z", "s2"), resp("u", "never")])
    jobs.consolidate(spark, raw.read_raw(spark, str(src / "2024-01-06")), root)
    assert jobs.rebuild_pending(spark, root, "month") == ["2024-01-01", "undated"]
    monthly = tiers.read_tier(spark, root, "session-rollup", "monthly").where("session_key = 's1'").collect()
    assert [(r["turns"], str(r["log_date"])) for r in monthly] == [(2, "2024-01-04")]
    assert state(spark, root) == built_at_once(spark, src, str(tmp_path / "once"))
    assert jobs.rebuild_pending(spark, root, "month") == [] and jobs.rebuild_pending(spark, root, "day") == []


def test_a_replaced_chunk_day_leaves_nothing_behind(spark, tmp_path):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z"), req("x", "2024-01-03T09:00:00Z", "gone"), req("y", "odd time", "gone")])
    put(src, "2024-01-07", "10", [req("z", "2024-01-07T09:00:00Z", "all bad")])
    built_at_once(spark, src, root)
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z")])
    put(src, "2024-01-07", "10", ["{torn"])
    bad = jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    assert [r["entry"] for r in bad.collect()] == ["{torn"] and {"path", "log_day", "log_hour"} <= set(bad.columns)
    jobs.rebuild_pending(spark, root, "month")
    assert state(spark, root) == built_at_once(spark, src, str(tmp_path / "once"))
    assert ci.days_in(spark, tiers.grain_path(root, "consolidated", "day")) == [date(2024, 1, 5)]
    owned = ci.read_manifest(spark, root, "sessions", "daily").collect()
    assert [(r["period"], r["rows"], r["entries"]) for r in owned] == [("2024-01-05", 1, 1)]


def test_a_run_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z"), req("x", "2024-01-03T09:00:00Z", "gone")])
    built_at_once(spark, src, root)
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z")])
    with monkeypatch.context() as m:
        m.setattr(jobs, "rebuild", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    jobs.rebuild_pending(spark, root, "month")
    assert state(spark, root) == built_at_once(spark, src, str(tmp_path / "once"))


def test_a_day_is_rebuilt_from_its_chunk_days_only(spark, tmp_path):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    for d in range(1, 10):
        put(src, f"2024-01-0{d}", "10", [req(f"r{d}", f"2024-01-0{d}T09:00:00Z"), req(f"l{d}", f"2024-01-0{max(d - 1, 1)}T23:59:59Z")])
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    rows = jobs.concerned_entries(spark, root, "day", {date(2024, 1, 4)}, ci.read_index(spark, root))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [log_date" in plan.replace("isnotnull(log_date", "log_date") and "2024-01-04" in plan and "2024-01-05" in plan
    assert "2024-01-06" not in plan
    read = {r[0].rsplit("log_date=", 1)[1][:10] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert rows.count() == 2 and read == {"2024-01-04", "2024-01-05"}
    before = plain(tiers.read_tier(spark, root, "sessions"), TURN_COLUMNS)
    jobs.rebuild(spark, root, "day", [date(2024, 1, 4)])
    assert plain(tiers.read_tier(spark, root, "sessions"), TURN_COLUMNS) == before


def test_rows_outside_the_replaced_days_touch_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "t string, n int").select(F.to_timestamp("t").alias("ts"), "n")
    assert tiers.replace_days(rows, path, [date(2024, 1, 1), date(2024, 1, 2)], "ts", ("ts",)) == {date(2024, 1, 1): 1, date(2024, 1, 2): 1}
    with pytest.raises(ValueError, match="outside"):
        tiers.replace_days(rows, path, [date(2024, 1, 1)], "ts", ("ts",))
    assert spark.read.parquet(path).count() == 2
    tiers.replace_days(rows.where("n = 2"), path, [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 9)], "ts", ("ts",))
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [2]


def run_stream(spark, src, root, checkpoint, **more):
    streams.stream_to_lake(spark, str(src), root, str(checkpoint), **more).awaitTermination()


def test_stream_and_batch_share_the_tier(spark, tmp_path):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z"), "{torn"])
    put(src, "2024-01-05", "11", [resp("a", "2024-01-05T09:00:09Z"), req("n", "no time")])
    run_stream(spark, src, root, tmp_path / "cp", files_per_batch=1)
    put(src, "2024-01-06", "00", [req("b", "2024-01-05T23:59:00Z")])
    jobs.consolidate(spark, raw.read_raw(spark, str(src / "2024-01-06")), root)  # a day the stream has not seen
    put(src, "2024-01-06", "01", [req("c", "2024-01-06T00:30:00Z")])
    run_stream(spark, src, root, tmp_path / "cp")  # brings both chunks of 01-06 again, one is new
    run_stream(spark, src, root, tmp_path / "lost", name="again")  # a lost checkpoint brings everything again
    for scope in tiers.GRAINS:
        jobs.rebuild_pending(spark, root, scope)
    want = built_at_once(spark, src, str(tmp_path / "once"))
    assert state(spark, root) == want
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)  # the batch takes all days over
    jobs.rebuild_pending(spark, root, "month")
    assert state(spark, root) == want
    index = ci.read_index(spark, root)
    assert {r["writer"] for r in index.collect()} == {ci.BATCH_WRITER} and index.agg(F.sum("rows"), F.sum("bad_rows")).first()[:] == (5, 1)
    pending = lifecycle.plan_consolidation(lifecycle.relative_to(providers.list_objects(spark, root), root), "2030-01-01")
    assert pending.count() == 0


def test_a_repeated_stream_batch_replaces_itself(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z")])
    lines = raw.read_raw(spark, str(src)).withColumnRenamed("log_day", "log_date")
    with monkeypatch.context() as m:  # published, but cut off before the index was written
        m.setattr(streams.ci, "write_index", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            streams.add_chunks(lines, root, "stream-live-0")
    for _ in range(2):
        streams.add_chunks(lines, root, "stream-live-0")
    streams.add_chunks(lines, root, "stream-live-1")
    assert tiers.read_tier(spark, root, "consolidated").count() == 1
    assert ci.names_in(spark, f"{root}/incoming") == []


def test_months_stand_in_for_pruned_days(spark, tmp_path):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    for day in ("2024-01-05", "2024-01-06", "2024-02-01"):
        put(src, day, "10", [req(day, f"{day}T09:00:00Z"), resp(day, f"{day}T09:00:01Z")])
    want = built_at_once(spark, src, root)
    jobs.compact_months(spark, root, [date(2024, 1, 1)])
    jobs.rebuild(spark, root, "month")
    listing = lifecycle.relative_to(providers.list_objects(spark, root), root)
    superseded = {(r["tier"], r["day"]) for r in lifecycle.plan_superseded(listing).collect()}
    assert ("consolidated", "2024-01-05") in superseded and ("consolidated", "2024-02-01") not in superseded
    for tier, day in superseded:
        ci.remove(spark, f"{root}/{tier}/daily/log_date={day}")
    history = {t: jobs.read_history(spark, root, t) for t in tiers.TIERS}
    assert plain(history["consolidated"], [*WIDE_COLUMNS, "log_date"]) == want["consolidated"]
    assert plain(history["sessions"], [*TURN_COLUMNS, "log_date"]) == want["sessions", "monthly"]
    assert plain(history["session-rollup"], [*ROLLUP_COLUMNS, "log_date"]) == want["session-rollup", "monthly"]
    # a late chunk for the pruned month: the new day counts beside the month, until the month is built again
    put(src, "2024-01-06", "11", [req("late", "2024-01-05T10:00:00Z")])
    jobs.consolidate(spark, raw.read_raw(spark, str(src / "2024-01-06")), root)
    ids = lambda df: sorted(r["request_id"] for r in df.select("request_id").collect())
    turns = ["2024-01-05", "2024-01-06", "2024-02-01", "late"]
    assert ids(jobs.read_history(spark, root, "sessions")) == turns
    jobs.rebuild_pending(spark, root, "month")
    jobs.compact_months(spark, root)
    assert ids(jobs.read_history(spark, root, "sessions")) == turns
    assert state(spark, root)["sessions", "monthly"] == built_at_once(spark, src, str(tmp_path / "once"))["sessions", "monthly"]


def test_the_scrub_reaches_raw_chunks_and_all_tiers(spark, tmp_path):
    src, root = tmp_path / "raw", str(tmp_path / "lake")
    leak = resp("a", "2024-01-05T09:00:01Z", content="password: hush1", tool_calls=[{"name": "q", "arguments": '{"s3_secret": "hush2"}'}])
    put(src, "2024-01-05", "10", [req("a", "2024-01-05T09:00:00Z"), leak, '{"torn": "api_key=hush3'])
    put(src, "2024-01-05", "11", [req("b", "2024-01-05T11:00:00Z")])
    put(src, "2024-01-09", "10", [req("today", "2024-01-09T09:00:00Z", user_question="token: hush4")])
    run_stream(spark, src, root, tmp_path / "cp")
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    jobs.rebuild(spark, root, "month")
    jobs.compact_months(spark, root)
    assert {r["place"] for r in jobs.verify_lake(spark, root, str(src)).collect()} >= {"raw", "consolidated/daily", "consolidated/monthly", "sessions/monthly"}
    before = {(str(r["log_day"]), r["log_hour"]): r["count"] for r in raw.read_raw(spark, str(src)).groupBy("log_day", "log_hour").count().collect()}
    jobs.scrub_history(spark, root, "2024-01-09", raw_root=str(src))
    assert all(r["residual_rows"] == 1 for r in jobs.verify_lake(spark, root, str(src)).collect())  # today is left alone
    jobs.scrub_history(spark, root, "2030-01-01", raw_root=str(src))
    assert jobs.verify_lake(spark, root, str(src)).count() == 0
    left = [p for p in tmp_path.rglob("*") if p.is_file() and p.suffix in (".jsonl", ".txt") and "hush" in p.read_text()]
    assert left == [] and (src / "2024-01-05" / "11-00-05-h-1-aa.jsonl").exists()
    after = {(str(r["log_day"]), r["log_hour"]): r["count"] for r in raw.read_raw(spark, str(src)).groupBy("log_day", "log_hour").count().collect()}
    assert after == before
    run_stream(spark, src, root, tmp_path / "cp")  # the published chunks are no new ones
    assert tiers.read_tier(spark, root, "consolidated").count() == 4
    jobs.consolidate(spark, raw.read_raw(spark, str(src)), root)
    assert jobs.verify_lake(spark, root, str(src)).count() == 0


def test_a_scrub_of_raw_chunks_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch):
    src = tmp_path / "raw"
    put(src, "2024-01-05", "10", ['{"secret": "hush"}', '{"n": 1}', '{"n": 2}'])
    real = ci.remove
    with monkeypatch.context() as m:
        m.setattr(ci, "remove", lambda spark, path: 1 / 0 if path.endswith(".jsonl") and "chunk=" not in path else real(spark, path))
        with pytest.raises(ZeroDivisionError):
            jobs.scrub_raw(spark, str(src), "2030-01-01")
    assert raw.read_raw(spark, str(src)).count() == 6
    report = jobs.scrub_raw(spark, str(src), "2030-01-01")
    assert sorted(r["entry"] for r in raw.read_raw(spark, str(src)).collect()) == ['{"n": 1}', '{"n": 2}', '{"secret": "[REDACTED]"}']
    assert report.agg(F.sum("changed_lines")).first()[0] == 1


def test_glued_and_torn_lines_are_quarantined(spark):
    good = ['{"a":1}', ' {"a":[{"b":"]"}]} ', '{"a":1,"a":2}', "{}", '{"a":"}{"}', "[1]", '{"a":"x] y"}']
    torn = ['{"a":1}{"b":2}', '{"a":1} xyz', '{"a":1}] x', '{"a":1}} x', '{"a":1},{"b":2}', '{"a":1}]}', '{"a":1},"y":{"b":2}', "{half", "", '{"a":[1]}]', "x"]
    rows = spark.createDataFrame([(x,) for x in good + torn], "entry string")
    kept, bad = raw.split_malformed(rows)
    assert {r[0] for r in kept.collect()} == set(good) and {r[0] for r in bad.collect()} == set(torn)
