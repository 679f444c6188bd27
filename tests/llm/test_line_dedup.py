"""Site-relative line frequencies against plain counting."""

import re
from collections import Counter, defaultdict

import pytest
from logloom.llm import line_dedup as d
from pyspark.sql import functions as F


def brute(rows, ratio, min_pages):
    total, holding = Counter(), defaultdict(Counter)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, host, text in rows:
        total[host] += 1
        holding[host].update({strip(x) for x in (text or "").split("\n") if strip(x)})
    bad = lambda host, x: holding[host][x] >= min_pages and holding[host][x] > ratio * total[host]
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not (strip(x) and bad(h, strip(x))))) for i, h, t in rows]


ROWS = (
    [(i, "a", f"menu\nbody {i}\n\n  footer \nmenu") for i in range(20)]
    + [(100 + i, "b", f"menu\ntext {i % 7}") for i in range(12)]
    + [(200, "c", "menu"), (201, "c", "menu"), (202, None, "menu\nx"), (203, None, "menu"), (204, None, " menu\t\n y "), (205, "a", None)]
    + [(206, "a", ""), (207, "a", "   \n\t"), (208, "b", "menu\ntext 1"), (208, "b", "menu\ntext 1"), (None, "b", "menu\nlast")]
    + [(300, "d", "é\xa0\n" + "long " * 100_000)]
)


@pytest.mark.parametrize("broadcast", [100_000, -1])
@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.95])
def test_lines(spark, monkeypatch, broadcast, ratio):
    monkeypatch.setattr(d, "BROADCAST_LINES", broadcast)
    frame = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id bigint, source string, text string, host string, key int")
    out = d.dedup_lines(frame, ratio=ratio)
    assert out.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, brute(ROWS, ratio, d.MIN_PAGES)))


def test_empty_table_and_n_chars(spark):
    frame = spark.createDataFrame([(*r, "en", 5) for r in ROWS], "doc_id bigint, source string, text string, lang string, n_chars bigint")
    assert d.dedup_documents(frame.limit(0)).count() == 0
    out = d.dedup_documents(frame, ratio=0.1)
    assert out.columns == frame.columns
    assert out.where("NOT n_chars <=> length(text)").count() == 0


@pytest.mark.parametrize("url,host", [
    ("http://www.Site.org:80/a?b=//x", "site.org"), ("https://u:p@m.site.org", "m.site.org"), ("ftp://x#y", "x"), ("no host", None),
    ("", None), (None, None), ("http:///path", None),
])
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(d.host_of(F.col("u"))).first()[0] == host


def test_outer_blanks_are_trimmed_as_the_contract_names_them(spark):
    """Every blank goes from both ends and no other character; a blank before a Unicode line terminator at the end is inside the line."""
    from logloom.llm.common import BLANKS
    from logloom.llm.line_dedup import BLANK_CHARACTERS, _bare

    assert sorted(BLANK_CHARACTERS) == [chr(c) for c in range(128) if re.fullmatch(f"[{BLANKS}]", chr(c))]
    lines = ["", " \t\n\x0b\f\r", " a b\t", "a \u0085", " a ", "a  ", "\x1ca\x1c", " é\n\n"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", _bare(F.col("x")).alias("b")).collect()
    assert {r.x: r.b for r in got} == {x: x.strip(BLANK_CHARACTERS) for x in lines}
