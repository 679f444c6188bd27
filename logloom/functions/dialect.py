"""Repair of tool-call arguments that still carry the model's own markup.

Some models leave `<arg_key>..</arg_key> <arg_value>..</arg_value>` or
`<parameter=name>..</parameter>` in the arguments string.  The payload is intact
inside the tags.  A native test picks the affected rows; the rebuild of a JSON
document of unknown shape is a small Arrow UDF over those rows only.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tags as the models emit them.  The last closing tag may be missing.
MARKERS = ("<arg_key>", "<arg_value>", "<parameter=")
REPAIR_TYPE = T.StructType(
    [T.StructField("arguments", T.StringType()), T.StructField("repaired", T.BooleanType())]
)


def has_markup(c: Column) -> Column:
    hit = F.lit(False)
    for marker in MARKERS:
        hit = hit | c.contains(marker)
    return hit


class _Tags:
    """Reads the tagged payloads of a text from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def after(self, mark: str) -> bool:
        """Moves behind the next `mark`; false where there is none."""
        found = self.text.find(mark, self.at)
        if found >= 0:
            self.at = found + len(mark)
        return found >= 0

    def until(self, mark: str, open_ended: bool = False) -> str | None:
        """The text up to `mark`, which is passed; up to the end where an open end is allowed."""
        end = self.text.find(mark, self.at)
        if end < 0:
            if not open_ended:
                return None
            end = len(self.text)
        part = self.text[self.at : end]
        self.at = min(end + len(mark), len(self.text))
        return part

    def value(self, closing: str):
        """The payload up to the closing tag: JSON where it is JSON, else text."""
        part = self.until(closing, open_ended=True).strip()
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            return part


def keyed_values(text: str) -> dict:
    """Names and payloads of a text in which keys and values are tagged apart."""
    tags, found = _Tags(text), {}
    while tags.after("<arg_key>"):
        name = tags.until("</arg_key>")
        if name is None:
            break
        gap = tags.text[tags.at :].lstrip()
        if gap.startswith("<arg_value>"):
            tags.after("<arg_value>")
            found[name.strip()] = tags.value("</arg_value>")
    return found


def named_values(text: str) -> dict:
    """Names and payloads of a text in which the name is inside the opening tag."""
    tags, found = _Tags(text), {}
    while tags.after("<parameter="):
        name = tags.until(">")
        if name is None:
            break
        found[name.strip()] = tags.value("</parameter>")
    return found


def inner_value(text: str, fallback=None):
    """The first payload inside one argument's value."""
    tags = _Tags(text)
    if tags.after("<arg_value>"):
        return tags.value("</arg_value>")
    if tags.after("<parameter=") and tags.until(">") is not None:
        return tags.value("</parameter>")
    return fallback


def repair_arguments(text: str) -> tuple[str, bool]:
    """The arguments as clean JSON, and whether anything had to be repaired."""
    try:
        given = json.loads(text)
    except (ValueError, RecursionError):
        given = None
    if not isinstance(given, dict):
        rebuilt = keyed_values(text) or named_values(text)
        return (json.dumps(rebuilt), True) if rebuilt else (text, False)
    kept = object()  # marks a value that needs no repair
    mended = {name: inner_value(value, kept) if isinstance(value, str) else kept for name, value in given.items()}
    if all(value is kept for value in mended.values()):
        return text, False
    return json.dumps({name: given[name] if value is kept else value for name, value in mended.items()}), True


@F.pandas_udf(REPAIR_TYPE)
def _repair_batch(args: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if a is None else repair_arguments(a) for a in args]
    return pd.DataFrame(rows, columns=["arguments", "repaired"]).astype(object)


def repair_tool_args(c: Column) -> Column:
    """Struct (arguments, repaired); clean strings pass through unchanged."""
    fixed = _repair_batch(F.when(has_markup(c), c))
    return F.struct(
        F.coalesce(fixed["arguments"], c).alias("arguments"),
        F.coalesce(fixed["repaired"], F.lit(False)).alias("repaired"),
    )
