import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import quality, routing
from logloom.plans import lifecycle
from logloom.session import shared_dir
from logloom.sources import bench, providers, tiers

CONFIG = {
    "providers": {
        "campus": {"endpoint": "e", "models": [], "model_prefixes": []},
        "vendor": {"endpoint": "e", "models": ["std"], "model_prefixes": ["acme/", "~"]},
        "deep": {"endpoint": "e", "models": [], "model_prefixes": ["acme/deep/"]},
        "lab": {"endpoint": "e", "models": ["local", "acme/mine"], "thinking_models": {"local": "enable_thinking"}},
    },
    "default_provider": "campus",
}


@pytest.fixture(scope="module")
def dimension(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cfg") / "config.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    return providers.read_providers(spark, str(path))


def test_provider_dimension(dimension):
    got = {r["provider"]: r for r in dimension.collect()}
    assert [got[p]["position"] for p in CONFIG["providers"]] == [0, 1, 2, 3]
    assert got["lab"]["prefixes"] == ["local", "acme/mine"] and got["vendor"]["prefixes"] == ["acme/", "~"] and got["campus"]["prefixes"] == []
    assert got["campus"]["is_default"] and not got["lab"]["is_default"] and got["lab"]["thinking_models"] == {"local": "enable_thinking"}


@pytest.mark.parametrize(
    "model, provider, how",
    [
        ("std", "vendor", "exact"), ("std-2", "campus", "default"), ("acme/x", "vendor", "prefix"), ("acme/mine", "lab", "exact"),
        ("acme/deep/y", "vendor", "prefix"), ("~z", "vendor", "prefix"), ("local", "lab", "exact"), ("local-big", "lab", "prefix"), ("", "campus", "default"),
    ],
)
def test_routing(spark, dimension, model, provider, how):
    r = routing.route_models(spark.createDataFrame([(model,), (model,)], "model string"), dimension, "campus").collect()
    assert [(x["provider"], x["matched_by"]) for x in r] == [(provider, how)]


def test_routing_without_default(spark, dimension):
    r = routing.route_models(spark.createDataFrame([("nobody",)], "model string"), dimension).first()
    assert (r["provider"], r["matched_by"]) == ("unrouted", "unrouted")


def test_catalog_degrades_and_never_disagrees_with_routing(spark, dimension):
    fetched = spark.createDataFrame([("vendor", "acme/a"), ("vendor", "google/g"), ("campus", "free")], "provider string, id string")
    previous = spark.createDataFrame([("deep", "acme/deep/q"), ("vendor", "old")], "provider string, id string")
    reached = spark.createDataFrame([("vendor",), ("campus",)], "provider string")
    cand = routing.candidate_ids(dimension, reached, fetched, previous)
    assert {(r["provider"], r["status"]) for r in cand.collect()} == {("vendor", "ok"), ("campus", "ok"), ("deep", "stale"), ("lab", "declared")}
    cat = routing.routable_catalog(cand, dimension, "campus")
    assert {(r["provider"], r["id"]) for r in cat.collect()} == {("vendor", "acme/a"), ("campus", "free"), ("lab", "local"), ("lab", "acme/mine")}
    counts = {r["provider"]: r["routable"] for r in routing.catalog_counts(cand, cat).collect()}
    assert counts == {"vendor": 1, "campus": 1, "deep": 0, "lab": 2}


def listing(spark, *paths):
    return spark.createDataFrame([(p, len(p)) for p in paths], "path string, length long")


def days(df):
    return sorted(r["day"] for r in df.collect())


def test_plans(spark):
    src = listing(
        spark, "2024-01-01/00-a.jsonl", "2024-01-01/01-b.jsonl", "2024-01-02/00-a.jsonl", "2024-01-03/00-a.jsonl", "2024-01-09/00-a.jsonl",
        "2024-13-45/00-a.jsonl", "notes/2024-01-04/x.jsonl", "consolidated/daily/2024-01-01.parquet", "consolidated/daily/2024-01-02.parquet",
        "consolidated/monthly/2023-12.parquet", "sessions/daily/2024-01-01.parquet", "consolidated/daily/2023-12-05.parquet", "consolidated/daily/readme.txt",
    )
    today = "2024-01-09"
    assert days(lifecycle.plan_consolidation(src, today)) == ["2024-01-03"]
    back = {(r["action"], r["day"]) for r in lifecycle.plan_backfill(src, today).collect()}
    assert back == {("build_turns", "2024-01-02"), ("build_turns", "2023-12-05"), ("build_rollup", "2024-01-01")}
    month = {(r["action"], r["day"]) for r in lifecycle.plan_backfill(src, today, "monthly").collect()}
    assert month == {("build_turns", "2023-12")}
    assert sorted(r["path"] for r in lifecycle.plan_sweep(src, today).collect()) == ["2024-01-01/00-a.jsonl", "2024-01-01/01-b.jsonl"]
    assert [(r["tier"], r["day"]) for r in lifecycle.plan_superseded(src).collect()] == [("consolidated", "2023-12-05")]
    mirror = listing(spark, "2024-01-01/00-a.jsonl", "consolidated/daily/2024-01-01.parquet")
    assert lifecycle.plan_prune(mirror, today).count() == 0


def test_today_is_never_swept(spark):
    src = listing(spark, "2024-01-09/00-a.jsonl", "consolidated/daily/2024-01-09.parquet", "sessions/daily/2024-01-09.parquet")
    assert lifecycle.plan_sweep(src, "2024-01-09").count() == 0 and lifecycle.plan_sweep(src, "2024-01-10").count() == 1


def test_mirror_diff(spark):
    src = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t2"), ("c", 3, "t3"), ("d", 4, "t4"), ("e", 5, None)], "path string, length long, mtime string")
    mir = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "old"), ("c", 9, "t3"), ("e", 5, None), ("x", 1, "t")], "path string, length long, tag string")
    got = {r["path"]: r["reason"] for r in lifecycle.mirror_diff(src, mir).collect()}
    assert got == {"b": "changed", "c": "changed", "d": "missing"}


def test_list_objects_and_counts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("12345")
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in providers.list_objects(spark, str(tmp_path)).collect()] == [("a.txt", 5)]
    before = spark.createDataFrame([("f",), ("f",), ("g",)], "k string")
    ok = {r["k"]: r["ok"] for r in lifecycle.counts_match(before, before.where("k = 'f'"), "k").collect()}
    assert ok == {"f": True, "g": False}


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "t")
    assert path != shared_dir(spark, "t") and (root is None or path.startswith(root))


def test_provenance(spark):
    tag = quality.PROVENANCE_TAG
    rows = [
        ("j1", tag + '{"agent":"a1","app_sha":"b","proxy_sha":"c"}'), ("j1", tag + '{"agent":"a1","app_sha":"b","proxy_sha":"c"}'),
        ("j2", tag + '{"agent":"unknown","proxy_sha":""}'), ("j3", "no provenance here"),
    ]
    got = {r["job"]: (r["unresolved"], r["valid"]) for r in quality.provenance_check(spark.createDataFrame(rows, "job string, line string")).collect()}
    assert got == {"j1": ("", True), "j2": ("agent,app_sha,proxy_sha", False)}


def test_orphan_audit(spark):
    rows = [("a", "request"), ("a", "response"), ("b", "request"), ("c", "response"), ("d", "request"), ("d", "request"), ("d", "response"), (None, "request"), ("s", "system_prompt")]
    got = quality.orphan_audit(spark.createDataFrame(rows, "request_id string, type string")).first()
    assert tuple(got) == (1, 1, 1)
    assert tuple(quality.orphan_audit(spark.createDataFrame([], "request_id string, type string")).first()) == (0, 0, 0)


def test_bench_inputs(spark, tmp_path):
    cols = "trial\tquestion\tmodel\telapsed_s\tllm_s\ttool_s\ttool_calls\tprompt_tok\tcompletion_tok\ttok_per_sec\ttimed_out\tcancelled\terror\tanswer_len\n"
    (tmp_path / "wet.summary.tsv").write_text(cols + "1\tq1\tm\t12.5\t1\t2\t3\t\t\t\tFalse\tFalse\t\t10\n1\tq2\tm\t\t\t\t\t\t\t\t\t\tno_transcript\t\n")
    got = bench.read_trials(spark, str(tmp_path / "*.summary.tsv")).orderBy("question").collect()
    assert [(r["app"], r["elapsed_s"], r["error"]) for r in got] == [("wet", 12.5, None), ("wet", None, "no_transcript")]

    (tmp_path / "grades.tsv").write_text("session_id\tapp\tq_idx\tmodel\tstatus\tscore\ns-1\twet\tq1\tm\tok\t0.5\ns-2\twet\tq1\tm\tbudget_capped\t\n")
    assert [r["score"] for r in bench.read_grades(spark, str(tmp_path / "grades.tsv")).orderBy("session_id").collect()] == [0.5, None]
    (tmp_path / "grades.raw").write_text("aa11bb22 1\ncc33dd44 0.5\n")
    assert {r["prefix"]: r["score"] for r in bench.read_raw_grades(spark, str(tmp_path / "grades.raw")).collect()} == {"aa11bb22": 1.0, "cc33dd44": 0.5}

    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "wet.txt").write_text("# head\nfirst?\n\n  second? \n#x\nthird?\n")
    asked = bench.read_questions(spark, str(tmp_path / "q")).orderBy("q_idx").collect()
    assert [(r["app"], r["q_idx"], r["question"]) for r in asked] == [("wet", 1, "first?"), ("wet", 2, "second?"), ("wet", 3, "third?")]

    golden = {"version": "1", "questions": [{"id": "a", "mode": "answer", "trap": ["x", "y"], "bench_mean_acc": 0.5}, {"id": "b", "mode": "clarify", "pairs_with": "a"}]}
    (tmp_path / "golden.json").write_text(json.dumps(golden, indent=1))
    g = {r["id"]: r for r in bench.read_golden(spark, str(tmp_path / "golden.json")).collect()}
    assert g["a"]["trap"] == ["x", "y"] and g["a"]["accuracy"] == 0.5 and g["b"]["pairs_with"] == "a" and g["b"]["accuracy"] is None

    run = {"model": "v/m", "trial": 2, "turns": [{"turn": 1, "type": "call", "name": "query"}], "llm_fetches": [{"ms": 5, "usage": None}], "response": "ok"}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "q3__v_m__t2.json").write_text(json.dumps(run, indent=2))
    t = bench.read_transcripts(spark, str(tmp_path / "runs")).first()
    assert (t["q_idx"], t["file_model"], t["file_trial"], t["turns"][0]["type"]) == ("q3", "v_m", 2, "call")


def test_counters_and_report_files(spark, tmp_path):
    spark.createDataFrame([("m", "x", 5)], "model string, metric string, value int").withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "c"))
    assert providers.read_counters(spark, str(tmp_path / "c")).first()["value"] == 5.0
    df = spark.createDataFrame([(1, "a\tb\n" + "c" * 200), (2, None)], "trial int, error string")
    tiers.write_report(df.coalesce(1), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.splitlines()[0] == "trial\terror" and "1\ta b " + "c" * 96 in text.splitlines() and "2\t" in text.splitlines()


def test_a_cell_join_reads_the_folders_of_its_region_only(spark, tmp_path):
    from logloom.operators.cells import cell_join
    from logloom.sources.cell_tables import read_cells, write_cells

    path = str(tmp_path / "cells")
    cells = spark.range(4000).select((F.col("id") % 16).alias("h0"), F.col("id").alias("cell"), F.lit(1.0).alias("value"))
    write_cells(cells, path)
    zones = spark.range(4000).select((F.col("id") % 16).alias("h0"), F.col("id").alias("cell"), F.concat(F.lit("z"), (F.col("id") % 16).cast("string")).alias("zone"))
    zones.write.parquet(str(tmp_path / "zones"))
    joined = cell_join(read_cells(spark, path), spark.read.parquet(str(tmp_path / "zones")).where("zone IN ('z3', 'z5')"))
    assert {(r["zone"], r["total"]) for r in joined.collect()} == {("z3", 250.0), ("z5", 250.0)}
    plan = joined._jdf.queryExecution().executedPlan()
    assert "SubqueryBroadcast dynamicpruning" in plan.toString()
    read = spark.read.parquet(path).where("h0 IN (3, 5)").select(F.input_file_name()).distinct().count()
    assert read < spark.read.parquet(path).select(F.input_file_name()).distinct().count()


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tasks_list_what_the_driver_would(spark, tmp_path, depth):
    from logloom.plans.lifecycle import relative_to
    from logloom.sources.providers import list_objects, list_prefixes

    for name in ("2024-01-01/00-a.jsonl", "2024-01-01/01-a.jsonl", "2024-01-02/chunk=00-b.jsonl/part-0", "top.txt", "t/daily/log_date=2024-01-01/x.parquet", "_hidden/x", "t/.y/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    (tmp_path / "empty").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        want = relative_to(list_objects(spark, root), root)
        got = relative_to(list_prefixes(spark, root, depth), root)
        key = lambda df: sorted((r["path"], r["length"], int(r["mtime"].timestamp())) for r in df.collect())
        assert key(got) == key(want) and got.count() == 5
    assert list_prefixes(spark, str(tmp_path / "empty")).count() == 0


def test_day_and_hour_of_a_chunk_come_from_one_search(spark):
    """Plain chunks, rewritten ones, and names that only look like either."""
    from logloom.sources import raw

    paths = {
        "s3a://b/2024-01-05/10-00-05-h-1-aa.jsonl": ("2024-01-05", 10), "/r/log_day=2024-01-05/chunk=09-00-05-h.jsonl/part-0.txt": ("2024-01-05", 9),
        "2024-01-05/chunk=9-0/part": (None, None), "2024-01-05/ab-0.jsonl": (None, None), "/r/2024-13-45/10-x": (None, 10), "10-2024-01-01": (None, None),
        "chunk=10-2024-01-01/part": (None, None), "/2024-01-01/10-x/part": (None, None), "": (None, None), "/2024-01-01/2024-01-02/07-": ("2024-01-02", 7),
    }
    c = F.col("p")
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", raw.chunk_day(c).cast("string").alias("d"), raw.chunk_hour(c).alias("h"))
    assert {r.p: (r.d, r.h) for r in df.collect()} == paths
    both = spark.range(1).select(raw.chunk_day(F.lit("x")), raw.chunk_hour(F.lit("x")))._jdf.queryExecution().logical().toString()
    assert both.count(raw._CHUNK) == both.count("regexp_extract(x, " + raw._CHUNK + ", 0)") > 0
