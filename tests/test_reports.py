import pytest
from pyspark.sql import functions as F

from logloom.operators import cells, metrics, scoring, stats


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# ---- log statistics --------------------------------------------------------


def log(spark, minute_counts):
    rows = [
        (f"2024-01-01 00:{minute:02d}:{i % 60:02d}", kind)
        for minute, counts in minute_counts.items() for kind, n in counts.items() for i in range(n)
    ]
    return frame(spark, "t string, type string", *rows).select(F.to_timestamp("t").alias("ts"), "type")


def test_balance(spark):
    df = log(spark, {0: {"request": 50, "response": 50}, 1: {"request": 3}, 3: {"request": 40, "response": 10, "other": 5}, 4: {"response": 30}})
    got = {r["window_start"].minute: (r["requests"], r["responses"], r["ratio"], r["alarm"]) for r in stats.log_balance(df).collect()}
    assert got == {0: (50, 50, 1.0, False), 1: (3, 0, 0.0, False), 3: (40, 10, 0.25, True), 4: (0, 30, None, False)}


def test_escalation(spark):
    df = spark.range(3005).select(F.lit("f").alias("fn"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").cast("string").alias("request_id"))
    assert sorted(r["nth"] for r in stats.failure_escalation(df).collect()) == [10, 100, 1000, 2000, 3000]


def test_slow_is_strict_and_only_good(spark):
    df = frame(spark, "error string, latency_ms long", (None, 300000), (None, 300001), ("x", 900000), (None, None))
    assert [r["latency_ms"] for r in stats.slow_completions(df).collect()] == [300001]


def test_tool_load_credits_delegates(spark):
    df = frame(spark, "tool_calls string", ('[{"name":"get_schema","arguments":"{}"},{"name":"query"}]',), ('[{"name":"get_schema"}]',), (None,), ("{}",))
    got = {r["name"]: (r["direct_calls"], r["effective_calls"]) for r in stats.tool_load(df).collect()}
    assert got == {"get_schema": (2, 2), "query": (1, 1), "get_stac_details": (0, 2)}


def test_window_prunes_days(spark):
    df = frame(spark, "t string", ("2024-01-01 12:00:00",), ("2024-01-03 12:00:00",)).select(F.to_timestamp("t").alias("ts"), F.to_date("t").alias("d"))
    end = F.lit("2024-01-03 12:00:00").cast("timestamp")
    assert stats.in_window(df, end - F.expr("INTERVAL 1 DAY"), end, day="d").count() == 1


# ---- scoring ---------------------------------------------------------------


def test_trial_status(spark):
    df = frame(
        spark, "timed_out string, error string",
        ("True", None), ("False", "it timed out"), ("False", "got 502"), (None, "500 x"), ("False", "boom"), ("False", "  "), (None, None),
    )
    got = [r["status"] for r in scoring.with_status(df).collect()]
    assert got == ["timeout", "timeout", "api_5xx", "api_5xx", "error", "ok", "ok"]


def test_any_turn_rule_differs_from_last_turn(spark):
    df = spark.createDataFrame(
        [("s", "https://a.x/r", "m", "q", "request", "2024-01-01 00:00:00", None), ("s", "https://a.x/r", "m", None, "response", "2024-01-01 00:00:01", "Org budget limit hit"),
         ("s", "https://a.x/r", "m", "q", "response", "2024-01-01 00:00:09.96", None)],
        "session_id string, origin string, model string, user_question string, type string, t string, error string",
    ).withColumn("ts", F.to_timestamp("t"))
    got = scoring.benchmark_sessions(df).first()
    assert (got["app"], got["turns"], got["wall_s"], got["status"]) == ("a", 2, 10.0, "budget_capped")


def test_two_accuracies_stay_apart(spark):
    trials = frame(
        spark, "app string, question string, model string, elapsed_s double, tool_calls double, timed_out string, error string",
        ("a", "q1", "m", 1.0, 2.0, "False", None), ("a", "q1", "m", 3.0, None, "False", None), ("a", "q2", "m", 9.0, 4.0, "True", None),
    )
    grades = frame(spark, "app string, question string, model string, score double", ("a", "q1", "m", 1.0), ("a", "q2", "m", 0.0))
    r = scoring.model_rollup(trials, grades).first()
    assert (r["ok"], r["n"], r["lat_med"], r["accuracy"], r["graded_cells"]) == (2, 3, 2.0, 0.5, 2)
    c = {x["question"]: x for x in scoring.cell_stats(trials).collect()}
    assert c["q1"]["tools_med"] == 1.0 and c["q2"]["lat_med"] is None and c["q2"]["tools_med"] == 0.0 and c["q2"]["ok"] == 0
    sessions = frame(
        spark, "model string, status string, score double, wall_s double, turns long",
        ("m", "ok", 1.0, 10.0, 2), ("m", "ok", 0.5, 20.0, 5), ("m", "ok", None, 30.0, 9), ("m", "budget_capped", 0.0, 1.0, 1),
    )
    s = scoring.model_summary(sessions).first()
    assert (s["attempts"], s["completed"], s["capped"], s["accuracy"], s["complete_pct"], s["median_wall_s"], s["median_turns"]) == (4, 3, 1, 0.75, 75.0, 20.0, 5.0)


def test_pivots_keep_gaps(spark):
    s = frame(
        spark, "app string, q string, model string, status string, score double, wall_s double, turns long",
        ("a", "q1", "x", "ok", 1.0, 5.0, 3), ("a", "q1", "x", "ok", 0.0, 7.0, 4), ("a", "q1", "y", "error", 1.0, 5.0, 3),
    )
    assert tuple(scoring.pivot_accuracy(s, ["x", "y"]).first()) == ("a", "q1", 0.5, None)
    assert tuple(scoring.pivot_wall(s, ["x", "y"]).first()) == ("a", "q1", 6.0, None)
    assert tuple(scoring.pivot_calls(s, ["x", "y"]).first()) == ("a", "q1", "3 (4)", None)


def test_gate_is_per_question(spark):
    old = frame(spark, "id string, score double", ("a", 0.2), ("b", 1.0), ("c", 0.5))
    new = frame(spark, "id string, score double", ("a", 1.0), ("b", 0.9), ("c", 0.5))
    targets = frame(spark, "id string", ("a",))
    v = scoring.gate_verdict(scoring.regression_gate(old, new, targets)).first()
    assert (v["regressions"], v["targets_fixed"], v["passed"]) == (1, True, False)  # the mean went up
    assert scoring.gate_verdict(scoring.regression_gate(old, old.withColumn("score", F.lit(1.0)), targets)).first()["passed"]


def test_clarify_keeps_questions_without_twin(spark):
    q = frame(
        spark, "id string, app string, question string, mode string, pairs_with string",
        ("p", "a", "precise", "answer", None), ("v", "a", "vague", "clarify", "p"), ("w", "a", "lone", "clarify", None),
    )
    assert {r["id"]: r["precise_question"] for r in scoring.clarify_pairs(q).collect()} == {"v": "precise", "w": None}


def test_transcripts(spark):
    from logloom.schemas import TRANSCRIPT

    turns = [(1, "call", "q", "{}", 1, None), (1, "result", "q", None, 2, 120.0), (2, "call", "q", "{}", 3, 999.0)]
    rows = [
        ("m", 1, "q", None, None, None, turns, [(2000.0, True, 200, (100, 50)), (500.0, False, 500, None)], 3.0, "answer", None, False, None),
        ("m", 2, "q", None, None, None, None, None, 1.0, None, "x", True, True),
    ]
    got = {r["trial"]: r for r in scoring.transcript_rollup(spark.createDataFrame(rows, TRANSCRIPT)).collect()}
    a, b = got[1], got[2]
    assert (a["tool_call_count"], a["llm_total_ms"], a["tool_total_ms"], a["prompt_tokens_total"], a["output_tok_per_sec"]) == (2, 2500.0, 120.0, 100, 25.0)
    assert (b["tool_call_count"], b["llm_total_ms"], b["output_tok_per_sec"]) == (0, 0.0, None)


# ---- metrics ---------------------------------------------------------------


def test_counter_resets_and_bucket_edges(spark):
    points = [("10:10", 5), ("10:50", 9), ("11:05", 12), ("11:30", 2), ("13:00", 4)]
    df = frame(spark, "model string, metric string, t string, value double", *[("m", "c", f"2024-01-01 {t}:00", float(v)) for t, v in points])
    got = metrics.counter_increase(df.withColumn("ts", F.to_timestamp("t"))).first()
    assert got["increase"] == 4 + 3 + 2 + 2


def test_split_guards_zeros(spark):
    inc = [("m", n, v) for n, v in zip(metrics.SERVING_METRICS.values(), (10.0, 5.0, 90.0, 5.0, 1000.0, 450.0, 30.0, 40.0))]
    inc += [("idle", "request_prefill_time_seconds_sum", 3.0), ("idle", "request_prefill_time_seconds_count", 0.5)]
    inc += [("half", "request_prefill_time_seconds_sum", 4.0), ("half", "request_prefill_time_seconds_count", 2.0)]
    table = metrics.metric_table(frame(spark, "model string, metric string, increase double", *inc))
    got = {r["model"]: r for r in metrics.prefill_decode_split(table).collect()}
    assert set(got) == {"m", "half"}
    m = got["m"]
    assert (m["prefill_avg_s"], m["decode_avg_s"], m["decode_per_prefill"], m["rate_ratio"], m["decode_time_pct"], m["cache_hit_pct"]) == (2.0, 18.0, 9.0, 20.0, 90.0, 75.0)
    assert (got["half"]["decode_avg_s"], got["half"]["rate_ratio"], got["half"]["cache_hit_pct"]) == (0.0, 0.0, 0.0)


def test_per_call_nulls(spark):
    schema = "call_id long, model string, latency_ms long, generation_ms long, prompt_tokens long, completion_tokens long, reasoning_tokens long"
    df = frame(spark, schema, (1, "m", 1000, 3000, 500, 90, 45), (2, "m", 0, 3000, 500, 0, 45), (3, "m", None, None, None, None, None))
    got = [tuple(r)[2:] for r in metrics.per_call_split(df).orderBy("call_id").collect()]
    assert got == [(75.0, 50.0, 30.0, 500.0), (None, None, None, None), (None, None, None, None)]


# ---- cells -----------------------------------------------------------------


def test_repeated_mask_cells_do_not_multiply(spark):
    values = frame(spark, "h0 int, cell int, klass string, value double", (1, 1, "a", 10.0), (1, 2, "a", 5.0), (2, 3, "b", 1.0))
    mask = frame(spark, "h0 int, cell int", (1, 1), (1, 1), (2, 9))
    assert [tuple(r) for r in cells.masked_sum(values, mask, ["h0", "cell"], "klass").collect()] == [("a", 10.0)]
    clipped = cells.region_subset(values, mask).agg(F.sum("value")).first()[0]
    only_h0 = cells.masked(values, mask, "h0").agg(F.sum("value")).first()[0]
    assert clipped == 10.0 < only_h0 == 16.0


def test_share_counts_distinct_cells(spark):
    land = frame(spark, "cell int", (1,), (1,), (2,), (3,), (4,))
    assert tuple(cells.share_of_total(land, frame(spark, "cell int", (1,), (1,), (9,))).first()) == (1, 4, 25.0)


def test_group_share_keeps_zero_ties(spark):
    zones = frame(spark, "zone string, cell int", *[(z, 10 * i + c) for i, z in enumerate("abc") for c in range(4)], ("tiny", 99))
    got = {r["zone"]: (r["share"], r["rank_low"]) for r in cells.group_share(zones, frame(spark, "cell int", (20,)), least=2).collect()}
    assert got == {"a": (0.0, 1), "b": (0.0, 1), "c": (0.25, 3)}


def test_overlay_takes_the_greatest_weight_and_guards_zero(spark):
    fc = frame(spark, "cell int, fid int, part double, whole double", (1, 1, 2.0, 4.0), (1, 1, 2.0, 4.0), (1, 2, 1.0, 4.0), (2, 3, 5.0, 0.0))
    frac = frame(spark, "cell int, klass string, frac double", (1, "x", 0.5), (2, "x", 0.5), (3, "y", 1.0))
    got = {r["klass"]: (r["total"], r["covered"], r["pct"]) for r in cells.weighted_overlay(frac, cells.cell_weight(fc, "part", "whole", "fid", ["cell"]), ["cell"], "klass").collect()}
    assert got == {"x": (1.0, 0.25, 25.0), "y": (1.0, 0.0, 0.0)}


def test_quantile_share(spark):
    pop = frame(spark, "id int, v double", *[(i, float(i)) for i in range(1, 6)], (5, 5.0))
    got = cells.quantile_share(pop, "id", "v", pop.distinct().withColumn("weight", F.lit(2.0))).first()
    assert got["threshold"] == pytest.approx(4.2) and got["pct"] == pytest.approx(20.0)


def test_composite_with_a_constant_metric(spark):
    g = frame(spark, "b string, x double, y double", ("p", 0.0, 7.0), ("q", 10.0, 7.0), ("r", 5.0, 7.0))
    got = {r["b"]: (r["composite"], r["rank"]) for r in cells.minmax_composite(g, ["x", "y"]).collect()}
    assert got == {"p": (0.0, 3), "q": (0.5, 1), "r": (0.25, 2)}


def test_attribution_modes(spark):
    fc = frame(spark, "fid int, cell int", (1, 1), (1, 2), (1, 3), (1, 3), (2, 3))
    zones = frame(spark, "cell int, zone string", (1, "a"), (2, "a"), (3, "b"))
    amounts = frame(spark, "fid int, amount double", (1, 90.0), (2, 10.0))
    full = {r["zone"]: (r["total"], r["features"]) for r in cells.full_overlap(fc, zones, amounts, "fid", "cell").collect()}
    assert full == {"a": (90.0, 1), "b": (100.0, 2)}
    split = {r["zone"]: r["total"] for r in cells.apportioned(fc, zones, amounts, "fid", "cell").collect()}
    assert split == {"a": pytest.approx(60.0), "b": pytest.approx(40.0)}


def test_ties_supports_and_totals(spark):
    c = frame(spark, "cell int, klass string", (1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a"))
    assert {r["cell"]: (r["klass"], r["n"]) for r in cells.dominant_class(c, "cell", "klass").collect()} == {1: ("a", 1), 2: ("b", 2)}
    means = frame(spark, "f string, mean_value double, cells long", ("one", 213.0, 1), ("ok", 210.0, 3))
    assert [r["f"] for r in cells.with_min_support(means).collect()] == ["ok"]
    rows = frame(spark, "zone string, wide boolean, amount double", ("a", True, 100.0), ("a", False, 1.0), ("b", True, 100.0), ("b", False, 5.0), ("c", True, 100.0))
    got = {r["zone"]: (r["wide_total"], r["local_total"], r["local_rank"]) for r in cells.separated_totals(rows, "zone", F.col("wide"), "amount").collect()}
    assert got == {"a": (100.0, 1.0, 2), "b": (100.0, 5.0, 1), "c": (100.0, 0.0, 3)}
    dup = frame(spark, "zone string, id int, amt double", ("a", 1, 5.0), ("a", 1, 5.0), ("a", 2, 1.0))
    assert tuple(cells.deduped_sum(dup, "zone", "id", "amt").first()) == ("a", 6.0, 2)
