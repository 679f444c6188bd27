import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators.flatten import fill_missing, flatten_entries, missing_columns, upgrade_schema
from logloom.operators.sessions import session_rollup, tier_compare
from logloom.operators.turns import live_union, pair_turns, union_tiers
from logloom.plans.jobs import consolidate, rebuild, scrub_history, verify_scrubbed
from logloom.schemas import ROLLUP_COLUMNS, ROLLUP_INPUTS, TURN_COLUMNS, WIDE_COLUMNS
from logloom.sources import raw, tiers


def req(rid, ts, sid="s1", **more):
    return json.dumps({
        "timestamp": ts, "type": "request", "request_id": rid, "session_id": sid, "origin": "https://app.example.org/agent_runner_x",
        "provider": "campus", "model": "m1", "message_count": 2, "user_question": "opener", "user_message_this_turn": f"ask {rid}",
        "tool_results_this_turn": None, "enable_thinking": None, **more,
    })


def resp(rid, ts, **more):
    return json.dumps({"timestamp": ts, "type": "response", "request_id": rid, "latency_ms": 1500, **more})


def usage(pt, ct, cost=None):
    u = {"prompt_tokens": pt, "completion_tokens": ct, "total_tokens": pt + ct, "prompt_tokens_details": {"cached_tokens": 1}}
    return {**u, "cost": cost} if cost is not None else u


LINES = [
    req("a1", "2024-01-01T23:50:00Z"),
    resp("a1", "2024-01-01T23:50:02.500Z", content="first", tokens=usage(10, 2, 0.5), tool_calls=[{"name": "q", "arguments": "{}"}]),
    req("a2", "2024-01-02T00:10:00Z", model="m2"),
    resp("a2", "2024-01-02T00:10:09Z", error="Provider returned 500: "),
    req("a3", "2024-01-02T00:20:00Z"),
    resp("a3", "2024-01-02T00:20:01Z", content="", tokens=usage(5, 1)),
    req("b1", "2024-01-01T10:00:00Z", sid="s2"),
    resp("zz", "2024-01-01T11:00:00Z", error="Unknown model x"),
    req("c1", "2024-01-01T12:00:00Z", sid=None), req("c2", "2024-01-05T12:00:00Z", sid=None),
    resp("c2", "2024-01-05T12:00:01Z", error="Request timed out after 9ms"),
]


@pytest.fixture(scope="module")
def entries(spark):
    return flatten_entries(spark.createDataFrame([(x,) for x in LINES], "entry string"))


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_flatten_types_and_verbatim_entry(entries):
    assert tuple(entries.columns) == WIDE_COLUMNS
    got = {(r["request_id"], r["type"]): r for r in entries.collect()}
    a1 = got[("a1", "response")]
    assert a1["entry"] == LINES[1] and a1["latency_ms"] == 1500 and json.loads(a1["tokens"])["cost"] == 0.5
    assert got[("a1", "request")]["tool_results"] is None and got[("a1", "request")]["message_count"] == 2
    assert a1["message_count"] is None and a1["error"] is None


def test_unreadable_values_are_null_not_lost(spark):
    bad = json.dumps({"timestamp": "soon", "type": "request", "message_count": "many", "latency_ms": "12.5", "enable_thinking": "perhaps"})
    r = flatten_entries(spark.createDataFrame([(bad,)], "entry string")).first()
    assert (r["ts"], r["message_count"], r["latency_ms"], r["enable_thinking"]) == (None, None, 13, None)


def test_upgrade_is_lossless_and_idempotent(entries):
    legacy = entries.select("ts", "type", "request_id", "origin", "entry")
    once = upgrade_schema(legacy)
    assert once.select(*WIDE_COLUMNS).exceptAll(entries).count() == 0
    assert upgrade_schema(once) is once
    stale = legacy.withColumn("model", F.lit("wrong"))
    assert upgrade_schema(stale).where(F.col("model") == "wrong").count() == 0


def test_fill_missing(spark):
    df = spark.createDataFrame([("k", 1)], "session_key string, turn_idx bigint")
    out = fill_missing(df, ROLLUP_INPUTS)
    assert out.columns == list(ROLLUP_INPUTS) and dict(out.dtypes)["latency_ms"] == "bigint"
    assert "latency_ms" in missing_columns(df, ROLLUP_INPUTS) and "turn_idx" not in missing_columns(df, ROLLUP_INPUTS)


def test_turns_pair_and_index(entries):
    t = pair_turns(entries, "month")
    assert tuple(t.columns) == ("period", *TURN_COLUMNS)
    got = by(t, "request_id")
    assert "zz" not in got and len(got) == 6
    assert [got[r]["turn_idx"] for r in ("a1", "a2", "a3")] == [1, 2, 3]
    assert got["b1"]["response_ts"] is None and got["a1"]["assistant_content"] == "first"
    assert got["c1"]["session_key"] == got["c2"]["session_key"] and got["c1"]["session_key"].startswith("anon:")
    day = by(pair_turns(entries, "day"), "request_id")
    assert [day[r]["turn_idx"] for r in ("a1", "a2", "a3")] == [1, 1, 2]


def test_repeated_request_id_fans_out_without_renumbering(spark):
    lines = [req("d", "2024-01-01T00:00:00Z"), resp("d", "2024-01-01T00:00:01Z"), resp("d", "2024-01-01T00:00:02Z"), req("e", "2024-01-01T00:01:00Z")]
    t = pair_turns(flatten_entries(spark.createDataFrame([(x,) for x in lines], "entry string")))
    assert sorted((r["request_id"], r["turn_idx"]) for r in t.collect()) == [("d", 1), ("d", 1), ("e", 2)]


def test_nearest_pairing_gives_one_row_per_request(spark):
    lines = [
        req("r", "2024-01-05T10:00:00Z"), req("r", "2024-01-05T12:00:00Z"), req("r", "2024-01-07T10:00:00Z"), req(None, "2024-01-05T10:00:00Z"),
        resp("r", "2024-01-05T09:00:00Z", latency_ms=1), resp("r", "2024-01-05T12:00:00Z", latency_ms=3), resp("r", "2024-01-05T12:00:00Z", latency_ms=2),
        resp("r", "2024-01-06T10:00:00Z", latency_ms=4), resp(None, "2024-01-05T10:00:00Z", latency_ms=5),
    ]
    wide = flatten_entries(spark.createDataFrame([(x,) for x in lines], "entry string"))
    got = [(str(r["request_ts"]), r["request_id"], r["latency_ms"]) for r in pair_turns(wide, nearest=True).collect()]
    assert sorted(got, key=str) == sorted([
        ("2024-01-05 10:00:00", None, None), ("2024-01-05 10:00:00", "r", 2), ("2024-01-05 12:00:00", "r", 2), ("2024-01-07 10:00:00", "r", None),
    ], key=str)
    assert pair_turns(wide).count() == 3 * 4 + 1


def test_null_request_ids_never_match(spark):
    lines = [req(None, "2024-01-01T00:00:00Z"), req(None, "2024-01-01T00:00:05Z"), resp(None, "2024-01-01T00:00:01Z")]
    t = pair_turns(flatten_entries(spark.createDataFrame([(x,) for x in lines], "entry string"))).collect()
    assert len(t) == 2 and all(r["response_ts"] is None for r in t)


def test_rollup(entries):
    s = session_rollup(pair_turns(entries, "month"))
    assert tuple(s.columns) == ROLLUP_COLUMNS
    got = by(s, "session_key")
    s1 = got["s1"]
    assert s1["status"] == "ok" and s1["error_turns"] == 1 and s1["turns"] == 3 and s1["models_used"] == 2
    assert s1["final_answer"] == "first" and s1["question"] == "ask a1" and s1["cost_usd"] == 0.5 and s1["cost_turns"] == 1
    assert s1["prompt_tokens"] == 15 and s1["cached_tokens"] == 2 and s1["tool_calls_total"] == 1 and s1["llm_ms_total"] == 4500
    assert s1["wall_clock_s"] == 1801.0 and s1["app"] == "app" and s1["run_tag"] == "/agent_runner_x"
    assert got["s2"]["status"] == "incomplete" and got["s2"]["unanswered_turns"] == 1 and got["s2"]["cost_usd"] is None
    anon = next(v for k, v in got.items() if k.startswith("anon:"))
    assert anon["session_key_synthetic"] and anon["status"] == "timeout" and anon["session_id"] is None


@pytest.mark.parametrize(
    "error, status",
    [
        (None, "ok"), ("x TIMED OUT y", "timeout"), ("Org budget limit exceeded", "budget_capped"), ("Your credit balance is too low", "budget_capped"),
        ("this requires more credits", "budget_capped"), ("Provider returned 500: ", "error"),
    ],
)
def test_last_turn_decides(spark, error, status):
    lines = [req("p", "2024-01-01T00:00:00Z"), resp("p", "2024-01-01T00:00:01Z", error="early failure")]
    lines += [req("q", "2024-01-01T00:01:00Z"), resp("q", "2024-01-01T00:01:01Z", **({"error": error} if error else {"content": "c"}))]
    s = session_rollup(pair_turns(flatten_entries(spark.createDataFrame([(x,) for x in lines], "entry string"))))
    assert s.first()["status"] == status


def test_rollup_of_an_old_turn_table(entries):
    old = pair_turns(entries, "month").drop("user_message_this_turn", "tokens")
    got = by(session_rollup(old), "session_key")
    assert got["s1"]["question"] == "opener" and got["s1"]["total_tokens"] is None


def test_day_and_month_totals_agree(entries):
    day = session_rollup(pair_turns(entries, "day"), "day")
    month = session_rollup(pair_turns(entries, "month"), "month")
    cmp = by(tier_compare(day, month), "session_key")
    assert all(r["totals_agree"] for r in cmp.values()) and cmp["s1"]["daily_rows"] == 2 and cmp["s1"]["monthly_rows"] == 1


def test_empty_input(entries):
    none = entries.where("false")
    assert pair_turns(none).count() == 0 and session_rollup(pair_turns(none)).count() == 0


def test_live_union_and_union_by_name(entries):
    stored = entries.where(F.col("ts") < "2024-01-02")
    assert live_union(stored, entries).count() == entries.count()
    both = union_tiers(entries, entries.select("ts", "type", "request_id", "origin", "entry"))
    assert both.count() == 2 * entries.count() and both.where(F.col("model").isNull()).count() > 0


def test_bad_scope(entries):
    with pytest.raises(ValueError):
        pair_turns(entries, "week")


def test_raw_reading(spark, tmp_path):
    day = tmp_path / "2024-01-03"
    day.mkdir()
    (day / "14-00-05-h-1-aa.jsonl").write_text(LINES[0] + "\n\n" + LINES[1][:30] + "\n")
    (day / "15-00-05-h-1-bb.jsonl").write_text(LINES[1] + "\n   \n")
    root = str(tmp_path)
    assert raw.read_raw(spark, root).count() == 3
    good, bad = raw.read_raw_tolerant(spark, root)
    assert {r["entry"] for r in good.collect()} == {LINES[0], LINES[1]}
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["14-00-05-h-1-aa.jsonl"]
    assert raw.in_hour(good, "2024-01-03", 15).first()["entry"] == LINES[1]
    assert spark.read.text(raw.hour_glob(root, "2024-01-03", 14)).count() == 3
    typed = raw.read_raw_typed(spark, "request_id string, error string", raw.hour_glob(root, "2024-01-03", 15))
    assert typed.first().asDict() == {"request_id": "a1", "error": None}


def test_pipeline_end_to_end(spark, tmp_path, entries):
    day = tmp_path / "raw" / "2024-01-02"
    day.mkdir(parents=True)
    (day / "01-00-00-h-1-aa.jsonl").write_text("\n".join(LINES) + "\n{half\n")
    root = str(tmp_path / "lake")
    bad = consolidate(spark, raw.read_raw(spark, str(tmp_path / "raw")), root)
    assert [r["entry"] for r in bad.collect()] == ["{half"]
    assert tiers.read_tier(spark, root, "consolidated").count() == len(LINES)
    assert tiers.read_tier(spark, root, "sessions", "daily").count() == 6
    daily = tiers.read_tier(spark, root, "session-rollup", "daily")
    rebuild(spark, root, "month")
    monthly = tiers.read_tier(spark, root, "session-rollup", "monthly")
    assert daily.count() == 5 and monthly.count() == 3
    want = session_rollup(pair_turns(entries, "month"), "month").select(*ROLLUP_COLUMNS)
    assert monthly.select(*ROLLUP_COLUMNS).exceptAll(want).count() == 0
    # A second run replaces its days and adds nothing.
    consolidate(spark, raw.read_raw(spark, str(tmp_path / "raw")), root)
    assert tiers.read_tier(spark, root, "sessions", "daily").count() == 6


def test_a_late_record_does_not_replace_its_day(spark, tmp_path):
    """Chunks are filed by flush day: the second day brings a record of the first, and an undated one each."""
    first = [req(f"d{i}", f"2024-01-01T1{i}:00:00Z") for i in range(6)] + [resp("u1", "sometime")]
    second = [req("late", "2024-01-01T23:59:50Z"), req("e1", "2024-01-02T08:00:00Z"), resp("u2", "never")]
    for day, lines in (("2024-01-01", first), ("2024-01-02", second)):
        (tmp_path / "raw" / day).mkdir(parents=True)
        (tmp_path / "raw" / day / "00-00-05-h-1-aa.jsonl").write_text("\n".join(lines) + "\n")
    root, once = str(tmp_path / "lake"), str(tmp_path / "once")
    for day in ("2024-01-01", "2024-01-02"):
        consolidate(spark, raw.read_raw(spark, str(tmp_path / "raw" / day)), root)
    consolidate(spark, raw.read_raw(spark, str(tmp_path / "raw")), once)
    for tier in tiers.TIERS:
        a, b = (tiers.read_tier(spark, r, tier) for r in (root, once))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0
    assert tiers.read_tier(spark, root, "consolidated").count() == 10
    assert tiers.read_tier(spark, root, "sessions").where("log_date = '2024-01-01'").count() == 7


def test_valid_documents_are_never_quarantined(spark):
    lines = ['{"a":1,"a":2}', '{"a":"' + "x" * 20_000_000 + '"}', '{"a":1}', "{half", "{'a': 1}", "[1]"]
    good, bad = raw.split_malformed(spark.createDataFrame([(x,) for x in lines], "entry string"))
    assert {r[0] for r in good.collect()} == set(lines[:3]) | {"[1]"} and {r[0] for r in bad.collect()} == {"{half", "{'a': 1}"}


def test_scrub_history_reaches_every_tier(spark, tmp_path):
    day = tmp_path / "raw" / "2024-01-02"
    day.mkdir(parents=True)
    leak = resp("a2", "2024-01-02T00:10:09Z", content="password: hush1", tool_calls=[{"name": "q", "arguments": '{"s3_secret": "hush2"}'}])
    (day / "01-00-00-h-1-aa.jsonl").write_text("\n".join([req("a1", "2024-01-01T00:00:00Z"), req("a2", "2024-01-02T00:10:00Z"), leak]) + "\n")
    root = str(tmp_path / "lake")
    consolidate(spark, raw.read_raw(spark, str(tmp_path / "raw")), root)
    dry = {str(r["log_date"]): r["rows_changed"] for r in scrub_history(spark, root, "2024-02-01", dry_run=True).collect()}
    assert dry == {"2024-01-02": 1} and verify_scrubbed(spark, root).count() == 1  # filed by chunk day
    scrub_history(spark, root, "2024-01-02")
    assert verify_scrubbed(spark, root).count() == 1  # today is left alone
    scrub_history(spark, root, "2024-02-01")
    assert verify_scrubbed(spark, root).count() == 0
    for tier in ("consolidated", "sessions", "session-rollup"):
        rows = tiers.read_tier(spark, root, tier).select(F.to_json(F.struct("*")).alias("j")).collect()
        assert rows and not any("hush" in r["j"] for r in rows), tier
    assert tiers.read_tier(spark, root, "consolidated").count() == 3


def test_write_tier_is_in_order_and_rewrite_is_safe(spark, tmp_path, entries):
    path = str(tmp_path / "t")
    tiers.write_tier(entries, path)
    back = spark.read.parquet(path)
    assert back.select(*WIDE_COLUMNS).exceptAll(entries).count() == 0
    one_file = back.withColumn("f", F.input_file_name())
    w = Window.partitionBy("f").orderBy(F.monotonically_increasing_id())
    assert one_file.withColumn("p", F.lag("ts").over(w)).where(F.col("p") > F.col("ts")).count() == 0

    with pytest.raises(RuntimeError, match="original untouched"):
        tiers.rewrite_in_place(spark, path, lambda df: df.where("type = 'request'"))
    assert spark.read.parquet(path).count() == len(LINES)
    one_day = spark.createDataFrame([("2024-01-02",)], "d string").select(F.to_date("d").alias("log_date"))
    n = tiers.rewrite_in_place(spark, path, lambda df: df.withColumn("error", F.lit("x")), only=one_day)
    after = spark.read.parquet(path)
    assert n == 4 and after.count() == len(LINES) and after.where("error = 'x'").count() == 4


def test_rewrite_jsonl_touches_changed_chunks_only(spark, tmp_path):
    from logloom.functions.scrub import scrub_json

    df = spark.createDataFrame(
        [('{"n": 1}', "/r/2024-01-01/00-a.jsonl", 2), ('{"secret": "a"}', "/r/2024-01-01/00-a.jsonl", 1), ('{"n": 2}', "/r/2024-01-02/00-b.jsonl", 1)],
        "entry string, path string, position int",
    )
    out = str(tmp_path / "o")
    report = {r["path"]: (r["lines"], r["changed_lines"]) for r in tiers.rewrite_jsonl(spark, df, scrub_json, out).collect()}
    assert report == {"/r/2024-01-01/00-a.jsonl": (2, 1), "/r/2024-01-02/00-b.jsonl": (1, 0)}
    lines = spark.read.text(out).collect()
    assert sorted(r["value"] for r in lines) == ['{"n": 1}', '{"secret": "[REDACTED]"}'] and {(str(r["log_day"]), r["chunk"]) for r in lines} == {("2024-01-01", "00-a.jsonl")}
    back = raw.read_raw(spark, out).select("entry", F.col("log_day").cast("string").alias("d"), "log_hour").orderBy("position").collect()
    assert [tuple(r) for r in back] == [('{"secret": "[REDACTED]"}', "2024-01-01", 0), ('{"n": 1}', "2024-01-01", 0)]


def test_mixed_schemas_read_by_name(spark, tmp_path, entries):
    entries.select("ts", "type", "request_id", "origin", "entry").write.parquet(str(tmp_path / "a"))
    entries.write.parquet(str(tmp_path / "b"))
    both = tiers.read_mixed(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert both.count() == 2 * len(LINES) and both.where("latency_ms = 1500").count() == 5


def test_short_rows_are_dealt_and_not_the_lines_made_of_them(spark, monkeypatch):
    """The log lines are put together after the shuffle that spreads the events; tiers made of stored rows need no such shuffle."""
    from logloom import fixtures as fx
    from logloom.registry import logs

    asked = {}
    monkeypatch.setattr(fx, "stored", lambda s, d, label, make, deal=True: asked.update({label: (make, deal)}) or spark.range(1))
    fx.log_lines(spark, "/root/testdata/sf0.001")
    make, deal = asked["log-lines"]
    plan = make()._jdf.queryExecution().optimizedPlan().toString()
    assert not deal and plan.index("timestamp") < plan.index("Repartition") and "props" not in plan[: plan.index("Repartition")]
    logs._consolidated(spark, "/root/testdata/sf0.001"), logs._stored_turns(spark, "/root/testdata/sf0.001")
    assert not asked["wide-tier"][1] and not asked["turn-tier"][1]


def test_ordered_writes_take_more_tasks_for_more_bytes(spark):
    rows = spark.range(1000)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tiers.by_range(rows, 3 * few, "id").rdd.getNumPartitions() == 3 * few
    assert tiers.TASK_BYTES <= 16 << 20 and spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
