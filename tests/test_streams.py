import json

from pyspark.sql import functions as F

from logloom.operators.flatten import flatten_entries
from logloom.operators.stats import log_balance
from logloom.schemas import WIDE_COLUMNS
from logloom.streaming import streams


def line(kind, rid, ts, **more):
    return json.dumps({"timestamp": ts, "type": kind, "request_id": rid, "session_id": "s", "model": "m", **more})


def at(minute, second=0):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


SENTINEL = [line("request", "end", "2024-02-01T00:00:00Z"), line("response", "end", "2024-02-01T00:00:00Z")]


def drain(spark, stream, tmp_path, name):
    run = streams.append_chunks(stream, str(tmp_path / name / "out"), str(tmp_path / name / "cp"))
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / name / "out"))


def put(folder, name, lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_consolidate_equals_batch_and_resumes(spark, tmp_path):
    src = tmp_path / "raw"
    put(src, "a.jsonl", [line("request", f"r{i}", at(i)) for i in range(20)])
    for _ in range(2):
        streams.stream_consolidate(spark, str(src), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        put(src, "b.jsonl", [line("response", f"r{i}", at(i, 5), latency_ms=5) for i in range(20)] + [""])
    got = spark.read.parquet(str(tmp_path / "t")).select(*WIDE_COLUMNS)
    want = flatten_entries(spark.read.text(str(src)).where("trim(value) != ''").select(F.col("value").alias("entry")))
    assert got.count() == 40 and got.exceptAll(want).count() == 0


def test_balance_equals_batch_and_drops_late_rows(spark, tmp_path):
    src = tmp_path / "raw"
    put(src, "1.jsonl", [line("request", f"a{i}", at(0, i)) for i in range(30)] + [line("response", f"a{i}", at(0, i)) for i in range(5)] + [line("request", "b", at(90))])
    entries = streams.entry_stream(streams.raw_stream(spark, str(src)))
    stream = streams.stream_balance(entries)
    out = drain(spark, stream, tmp_path, "bal")
    assert [(r["requests"], r["responses"], r["ratio"], r["alarm"]) for r in out.collect()] == [(30, 5, 0.167, True)]
    batch = log_balance(flatten_entries(spark.read.text(str(src)).select(F.col("value").alias("entry"))))
    assert out.exceptAll(batch).count() == 0
    put(src, "2.jsonl", [line("response", "late", at(0, 50))] + SENTINEL)
    after = drain(spark, streams.stream_balance(streams.entry_stream(streams.raw_stream(spark, str(src)))), tmp_path, "bal")
    assert sorted((r["requests"], r["responses"]) for r in after.where("window_start < '2024-01-15'").collect()) == [(1, 0), (30, 5)]


def test_pair_waits_for_the_budget(spark, tmp_path):
    src = tmp_path / "raw"
    put(src, "1.jsonl", [
        line("request", "ok", at(0)), line("response", "ok", at(19), latency_ms=7), line("request", "slow", at(1)), line("response", "slow", at(30)),
        line("request", "bad", at(2)), line("response", "bad", at(2, 9), error="x"), line("request", "gone", at(3)), line("response", "alone", at(4)), *SENTINEL,
    ])
    out = drain(spark, streams.stream_pair(streams.entry_stream(streams.raw_stream(spark, str(src)))), tmp_path, "pair")
    got = {r["request_id"]: r["outcome"] for r in out.where("request_ts < '2024-01-15'").collect()}
    assert got == {"ok": "ok", "slow": "incomplete", "bad": "error", "gone": "incomplete"}


def test_prompts_seen_once_across_batches(spark, tmp_path):
    src = tmp_path / "m"
    rows = [("system", "p1"), ("user", "u"), ("system", "p2"), ("system", "p1"), ("system", None)]
    for i in range(3):
        spark.createDataFrame(rows, "role string, content string").write.mode("append").parquet(str(src))
        said = spark.readStream.schema("role string, content string").parquet(str(src))
        streams.stream_prompts(said, str(tmp_path / "d"), str(tmp_path / "cp")).awaitTermination()
    # A lost checkpoint repeats everything and still adds nothing.
    said = spark.readStream.schema("role string, content string").parquet(str(src))
    streams.stream_prompts(said, str(tmp_path / "d"), str(tmp_path / "cp2")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r["content"] for r in out.collect()) == ["p1", "p2"]
    assert streams.compact_prompts(spark, str(tmp_path / "d")) == 2
    assert streams.read_prompts(spark, str(tmp_path / "d")).columns == ["system_sha256", "content"]


def test_prompt_dictionary_adds_files_only_for_new_prompts(spark, tmp_path):
    src, target = tmp_path / "m", tmp_path / "d"

    def files():
        return sorted(str(f.relative_to(target)) for f in target.rglob("*.parquet"))

    def run(*prompts):
        spark.createDataFrame([("system", p) for p in prompts], "role string, content string").coalesce(1).write.mode("append").parquet(str(src))
        said = spark.readStream.schema("role string, content string").parquet(str(src))
        streams.stream_prompts(said, str(target), str(tmp_path / "cp")).awaitTermination()

    run()
    assert files() == [] and streams.read_prompts(spark, str(target)).count() == 0 and streams.compact_prompts(spark, str(target)) == 0
    run(*[f"p{i}" for i in range(300)])
    first = files()
    assert len({f.split("/")[0] for f in first}) == len(first) > 100
    run("p1", "p2", "p2")
    assert files() == first
    run("p1", "new")
    assert len(files()) == len(first) + 1
    assert streams.compact_prompts(spark, str(target)) == 301
    assert len(files()) <= len(first) + 1
    assert {r["content"] for r in streams.read_prompts(spark, str(target)).collect()} == {"new", *[f"p{i}" for i in range(300)]}


def test_a_drained_stream_keeps_its_own_columns(spark):
    """What the registered streams read back is the stream's table, whatever its columns, and not the prompt dictionary's."""
    from logloom.registry import streams as registered

    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().select(F.col("value").alias("n"), "timestamp")
    out = registered._drain(stream, spark, "drained")
    assert out.columns == ["n", "timestamp"] and out.schema == stream.schema and sorted(r.n for r in out.collect()) == [0, 1, 2]
