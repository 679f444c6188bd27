"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing gives one archive or more per task, every record a gzip member of its own, and an index
row per record: archive, offset, length, URL, payload digest.  The index is the committed
table; a retried task writes archives under new names, and those that no index row names are
never read.  Of records with equal payloads the one with the least page id is the response, the
others are revisits that refer to it.

Reading takes any selection of index rows, sorts them by archive and offset, and reads
neighbouring ranges at once: gaps up to ``MAX_GAP`` are read over, a range grows to
``MAX_RANGE``.  Rows are dealt to tasks by archive and stretch, so a large archive is shared.

Archives go to any file system that pyarrow opens by URI (local, S3, GCS, ABFS, HDFS); Hadoop's names
for S3 are translated.

Cases: a null payload is empty; a null URL is left out, line breaks in one are percent-encoded;
a null page id is the least of none: such a row is a response only if no row with its payload
has an id; rows that repeat the response's page id are responses as well; empty tables write
no archive and give no rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import staged, string_or_empty, table
from logloom.session import shared_dir

ARCHIVE_BYTES = 256 << 20
MAX_GAP = 64 << 10
MAX_RANGE = 8 << 20
STRETCH_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, url string, digest string, record_type string, archive string, offset bigint, length bigint"
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        headers.append(f"X-Page-ID: {page_id}")
    if url is not None:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            headers.append(f"X-Refers-To-Page-ID: {refers_to}")
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of one record, from its gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stored = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != stored:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": stored,
        "payload": None if revisit else payload,
    }


# Schemes that Hadoop has names of its own for.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def archive_uri(directory: str) -> str:
    """A folder as pyarrow names it."""
    scheme, mark, rest = directory.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else directory


def write_archives(
    pages: DataFrame, directory: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row below `directory`; returns the index, read from its own table."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        string_or_empty(F.col(payload)).alias("payload"),
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    firsts = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("sha1").alias("of")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("times")).where("times > 1")
    )
    # a table of its own: a join with an aggregate on the join key is not split, and a payload may be on a third of all pages
    firsts = staged(firsts, "warc-firsts")
    linked = rows.join(firsts, F.col("sha1") == F.col("of"), "left").select(
        "page_id", "url", "payload", "sha1", "first_id",
        (F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(archive_uri(directory))
        out, name, at = None, None, 0
        try:
            for batch in batches:
                index = []
                for row in zip(*(batch.column(i) for i in range(6))):
                    page, address, text, sha1, first, revisit = (v.as_py() for v in row)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = record(page, address, text.encode(), digest, first if revisit else None, revisit)
                    out.write(member)
                    kind = "revisit" if revisit else "response"
                    index.append((page, address, digest, kind, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*index)) or [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["page_id", "url", "digest", "record_type", "archive", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return staged(linked.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, directory: str, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """The records that the rows of `index` name (columns of RECORD); the payload of a revisit is null."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(archive_uri(directory))
        opened: tuple[str, object] | None = None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            i = 0
            while i < len(rows):
                archive, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == archive and rows[j][1] - end <= max_gap and rows[j][1] + rows[j][2] - start <= max_range:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if opened is None or opened[0] != archive:
                    if opened is not None:
                        opened[1].close()
                    opened = archive, store.open_input_file(f"{root}/{archive}")
                data = opened[1].read_at(end - start, start)
                found = [parse(data[at - start : at - start + n]) for _, at, n in rows[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds)], names)
                i = j
        if opened is not None:
            opened[1].close()

    ranges = index.select("archive", "offset", "length")
    # as many tasks as there are stretches of bytes to read: the index rows themselves are too small to tell
    stretches = (ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] or 0) // STRETCH_BYTES + 1
    place = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = ranges.repartition(stretches, "archive", place).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = shared_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), directory)
    return read_records(index, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT h, min(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> s) & 31) + 1, 1)), '')), '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (h)
"""
