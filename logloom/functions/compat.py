"""Small column helpers that pin JSON, cast and ordering semantics once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jstr(doc: Column | str, path: str) -> Column:
    """Text at a JSON path; an absent path and a JSON null are both SQL NULL."""
    return F.get_json_object(_col(doc), path)


def jlen(doc: Column | str) -> Column:
    """Length of a JSON array, 0 for anything that is not an array."""
    return F.coalesce(F.json_array_length(_col(doc)), F.lit(0))


def to_bigint(text: Column | str) -> Column:
    """Whole number from text; '12.5' rounds, anything unreadable is NULL."""
    c = _col(text)
    return F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("double")).try_cast("bigint"))


def to_int(text: Column | str) -> Column:
    return to_bigint(text).try_cast("int")


def to_double(text: Column | str) -> Column:
    return _col(text).try_cast("double")


def to_bool(text: Column | str) -> Column:
    return _col(text).try_cast("boolean")


def millis(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds with millisecond grain, as a double."""
    return (millis(end) - millis(start)).cast("double") / F.lit(1000.0)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column | str, digits: int = 0) -> Column:
    """Rounds the way analytical SQL engines do: scale, round half away, scale back.

    Spark's own `round` works on the shortest decimal of a double and differs
    from that on values such as 0.145.
    """
    scale = float(10**digits)
    return F.round(_col(c) * F.lit(scale)) / F.lit(scale) if digits else F.round(_col(c))


def asc_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def spread_nulls(key: Column | str, *salt: Column | str) -> Column:
    """A join key whose NULLs never match but do not pile up in one task."""
    k = _col(key)
    fill = F.concat(F.lit("\u0000"), F.xxhash64(*[_col(s) for s in salt]).cast("string"))
    return F.coalesce(k, fill)
