"""Line dedup by site-relative frequency.

For every host: pages holding a line divided by the pages of the host.  A line on at least
``min_pages`` pages whose ratio exceeds ``ratio`` is boilerplate there and is dropped from all
the host's pages; the same line elsewhere stays.

A page contributes each distinct line once, as a 128-bit digest, and counts combine before the
shuffle.  A host has fewer than (distinct lines per page) / ratio boilerplate lines, so its
list is small; the lists go back to the pages by host.  They are broadcast only after their
size was counted; otherwise the join shuffles and AQE splits a heavy host.

Cases: lines are compared without the blanks around them; a line of blanks alone is never
boilerplate and is kept as it is; null texts hold no line and stay null; pages without a host
form one group; repeated pages count each, unless ``copies`` is off: then pages of a host with
the same lines count as one page, both among those that hold a line and among all, so that the
copies of a text never make its lines boilerplate; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import BLANKS, staged, string_or_empty, table

RATIO = 0.1
MIN_PAGES = 3
# Lists with at most this many lines in all (32 bytes each) are sent to every executor.
BROADCAST_LINES = 100_000

# Segments between tags are the lines of a page; scripts, styles and comments are not text.
HTML_BREAK = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|<[^>]*>|\n"


def host_of(url: Column) -> Column:
    """Lower-cased host name without user, port or www prefix; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def html_lines(html: Column) -> Column:
    return F.split(html, HTML_BREAK, -1)


# The characters of BLANKS, for a trim, which needs no pattern; a line's end is the end of the text, whatever terminator it holds.
BLANK_CHARACTERS = " \t\n\x0b\f\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK_CHARACTERS))


def _key(line: Column) -> Column:
    """Digest of the line without outer blanks; null for a line of blanks alone."""
    bare = _bare(line)
    return F.when(bare != "", F.md5(bare))


def _distinct_pages(pages: DataFrame) -> DataFrame:
    """One row of (host, keys) for each host and sequence of keys; copies combine before the shuffle."""
    told = pages.withColumn("digest", F.md5(F.array_join("keys", ",")))
    return staged(told.groupBy("host", "digest").agg(F.first("keys").alias("keys")).drop("digest"), "distinct-pages")


def _boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """From (host, keys): host, boilerplate (array of line digests)."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= min_pages)
    totals = totals.withColumnRenamed("host", "total_host")
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
    frequent = frequent.where(F.col("holding") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list("key").alias("boilerplate"))


def drop_boilerplate(
    pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True,
) -> DataFrame:
    """`pages` with two columns more: __lines (all) and __kept (those that stay), in order.

    `lines` is an array of lines, null for none.  The two names must be free.
    """
    keys = F.transform(lines, lambda x: _key(x))
    per_page = pages.select(host.alias("host"), keys.alias("keys"))
    if not copies:
        per_page = _distinct_pages(per_page)
    frequent = staged(_boilerplate(per_page, ratio, min_pages), "boilerplate")
    listed = frequent.select(F.col("host").alias("__host"), F.col("boilerplate").alias("__boilerplate"))
    size = frequent.agg(F.coalesce(F.sum(F.size("boilerplate")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        listed = F.broadcast(listed)
    joined = pages.withColumn("__lines", lines).join(listed, host.eqNullSafe(F.col("__host")), "left")
    kept = F.when(F.col("__boilerplate").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~F.coalesce(F.array_contains(F.col("__boilerplate"), _key(x)), F.lit(False)))
    )
    return joined.withColumn("__kept", kept).drop("__host", "__boilerplate")


def dedup_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True,
) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`; columns and their order unchanged."""
    # the other columns travel as one, so that no name of theirs can clash
    rest = [c for c in docs.columns if c not in (host, text)]
    packed = docs.select(F.col(host).alias("host"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    marked = drop_boilerplate(packed, F.col("host"), F.split(F.col("text"), "\n", -1), ratio, min_pages, copies)
    value = {host: F.col("host"), text: F.array_join("__kept", "\n")}
    return marked.select(*(value.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def dedup_documents(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """`dedup_lines` on the documents table, by source, with n_chars brought up to date."""
    return dedup_lines(docs, ratio=ratio, min_pages=min_pages, copies=copies).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its lines with words, those dropped, and the digest of the rest."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    marked = drop_boilerplate(pages, host_of(F.col("url")), html_lines(string_or_empty(F.col("html"))))
    text = lambda c: F.filter(c, lambda x: _bare(x) != "")
    worded = marked.select("page_id", host_of(F.col("url")).alias("host"), text(F.col("__lines")).alias("a"), text(F.col("__kept")).alias("b"))
    return worded.select(
        "page_id", "host", F.size("a").cast("long").alias("n_lines"), (F.size("a") - F.size("b")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("b", "\n"), 256).alias("kept_sha256"),
    )


OP9_SQL = rf"""
WITH split_pages AS (
    SELECT row_number() OVER () AS r, page_id,
           nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', ''), '') AS host,
           list_filter(string_split_regex(coalesce(html, ''), '{HTML_BREAK}'), lambda x: regexp_matches(x, '[^{BLANKS}]')) AS a
    FROM pages
), keyed AS (
    SELECT *, list_transform(a, lambda x: regexp_replace(x, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')) AS k FROM split_pages
), totals AS (SELECT host, count(*) AS pages FROM split_pages GROUP BY host
), held AS (
    SELECT host, key, count(*) AS holding FROM (SELECT r, host, unnest(list_distinct(k)) AS key FROM keyed) GROUP BY host, key
), frequent AS (
    SELECT h.host, list(h.key) AS boilerplate FROM held h JOIN totals t ON h.host IS NOT DISTINCT FROM t.host
    WHERE h.holding >= {MIN_PAGES} AND h.holding > {RATIO} * t.pages GROUP BY h.host
), kept AS (
    SELECT k.*, [k.a[i] FOR i IN range(1, len(k.a) + 1) IF NOT coalesce(list_contains(f.boilerplate, k.k[i]), false)] AS b
    FROM keyed k LEFT JOIN frequent f ON k.host IS NOT DISTINCT FROM f.host
)
SELECT page_id, host, len(a) AS n_lines, len(a) - len(b) AS n_dropped, sha256(array_to_string(b, chr(10))) AS kept_sha256 FROM kept
"""
