"""Archives: exact round trip, revisits, selections and coalesced reads."""

import gzip
import hashlib

import pytest
from logloom.llm import warc as w
from pyspark.sql import functions as F
from logloom.session import shared_dir
from pyarrow import fs

ROWS = [
    (5, "http://a/1", "<p>x</p>"), (3, "http://a/2", "<p>x</p>"), (7, None, "<p>x</p>"), (1, "http://a/\r\nX: y", ""), (2, "u", None),
    (None, "http://n", "only"), (None, "http://m", "<p>x</p>"), (8, "é", "WARC/1.1\r\n\r\nHTTP é\r\n\r\n"), (9, "v", "y" * 300_000),
    (3, "http://a/2", "<p>x</p>"),
]


def written(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")
    directory = shared_dir(spark, "test-warc")
    return w.write_archives(frame.repartition(3), directory, **options), directory


def expected(rows, min_bytes=0):
    payload = [(h or "").encode() for *_, h in rows]
    first = {}
    for (page, *_), p in zip(rows, payload):
        if page is not None:
            first[p] = min(page, first.get(p, page))
    out = []
    for (page, url, _), p in zip(rows, payload):
        revisit = len(p) >= min_bytes and payload.count(p) > 1 and page != first.get(p)
        url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
        out.append((page, url, "revisit" if revisit else "response", first.get(p) if revisit else None, len(p), w.base32_sha1(p), None if revisit else p))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 300}, {"min_bytes": 9}])
@pytest.mark.parametrize("reading", [{}, {"max_range": 1}, {"max_gap": -1}])
def test_round_trip(spark, options, reading):
    index, directory = written(spark, ROWS, **options)
    got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in w.read_records(index, directory, **reading).collect()), key=str)
    assert got == expected(ROWS, options.get("min_bytes", 0))


def test_archives_are_gzip_members_at_the_indexed_places(spark):
    index, directory = written(spark, ROWS)
    store, root = fs.FileSystem.from_uri(directory)
    for r in index.collect():
        with store.open_input_file(f"{root}/{r.archive}") as f:
            text = gzip.decompress(f.read_at(r.length, r.offset)).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: " + r.record_type) and f"sha1:{r.digest}\r\n" in text and text.endswith("\r\n\r\n")
    for name in {r.archive for r in index.collect()}:
        with store.open_input_stream(f"{root}/{name}", compression=None) as f:
            assert gzip.decompress(f.read()).count(b"WARC-Record-ID") == index.where(index.archive == name).count()


def test_selection_and_empty(spark):
    index, directory = written(spark, ROWS)
    got = w.read_records(index.where("url LIKE 'http://a/%' AND record_type = 'response'"), directory).collect()
    assert {r.page_id for r in got} == {1, 3}
    assert w.read_records(index.limit(0), directory).count() == 0
    empty, where = written(spark, [])
    assert empty.count() == 0 and w.read_records(empty, where).count() == 0


def test_hadoop_schemes_are_translated():
    assert w.archive_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and w.archive_uri("s3n://b") == "s3://b"
    assert [w.archive_uri(x) for x in ("/tmp/x", "file:/tmp/x", "file:///x", "gs://b/x", "hdfs://h:1/x")] == [
        "/tmp/x", "file:/tmp/x", "file:///x", "gs://b/x", "hdfs://h:1/x"
    ]


def test_a_payload_on_a_third_of_all_pages_is_split(spark):
    """With small thresholds the plan of the write shows a skew split."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    hot = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(50))  # does not shrink in the shuffle
    pages = spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id").cast("string")).alias("html")
    )
    plans = []
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        real = w.staged

        def seen(df, label):
            out = real(df, label)
            if label == "warc-index":
                df.write.format("noop").mode("overwrite").save()
                collected = df.collect()
                plans.append(df._jdf.queryExecution().executedPlan().toString() if collected else "")
            return out

        w.staged = seen
        index = w.write_archives(pages, "file:" + w.shared_dir(spark, "split-archives"))
    finally:
        w.staged = real
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plans[0] and index.count() == 4000
