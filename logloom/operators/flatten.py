"""From verbatim JSON entries to typed columns, and schema upkeep of stored tiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import to_bigint, to_bool, to_int
from logloom.schemas import ENTRY_TEXT, SENTINEL_COLUMN, WIDE_COLUMNS


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL when it is not one."""
    return F.try_to_timestamp(text)


def flatten_entries(df: DataFrame, entry: str = "entry") -> DataFrame:
    """The 21 wide columns of every entry.

    The document is parsed once per row, whatever the number of columns read.
    `ts`, `type`, `request_id` and `origin` are taken from the frame where it
    has them (a stored tier), else from the document (raw lines).  The document
    itself is kept verbatim.  Further columns of the frame are kept as well.
    """
    doc = "__doc"
    have = set(df.columns)
    parsed = df.withColumn(doc, F.from_json(F.col(entry), ENTRY_TEXT))

    def field(name: str) -> Column:
        return F.col(f"{doc}.{name}")

    def own(name: str, otherwise: Column) -> Column:
        return F.col(name) if name in have else otherwise

    typed = {
        "ts": own("ts", parse_timestamp(field("timestamp"))),
        "type": own("type", field("type")),
        "request_id": own("request_id", field("request_id")),
        "session_id": field("session_id"),
        "origin": own("origin", field("origin")),
        "client": field("client"),
        "provider": field("provider"),
        "model": field("model"),
        "message_count": to_int(field("message_count")),
        "tools_count": to_int(field("tools_count")),
        "enable_thinking": to_bool(field("enable_thinking")),
        "user_question": field("user_question"),
        "user_message_this_turn": field("user_message_this_turn"),
        "latency_ms": to_bigint(field("latency_ms")),
        "has_tool_calls": to_bool(field("has_tool_calls")),
        "has_content": to_bool(field("has_content")),
        "tool_calls": field("tool_calls"),
        "tool_results": field("tool_results_this_turn"),
        "tokens": field("tokens"),
        "error": field("error"),
        "entry": F.col(entry),
    }
    extra = [c for c in df.columns if c not in typed and c != entry]
    return parsed.select(*[c.alias(n) for n, c in typed.items()], *extra)


def upgrade_schema(df: DataFrame) -> DataFrame:
    """A legacy or stale tier brought to the wide schema; a no-op on a current one.

    Wide columns are always rebuilt from `entry`, never carried over, so a
    second pass changes nothing and columns added later are filled in too.
    """
    if SENTINEL_COLUMN in df.columns:
        return df
    rebuilt = set(WIDE_COLUMNS) - {"ts", "type", "request_id", "origin", "entry"}
    return flatten_entries(df.drop(*rebuilt))


def missing_columns(df: DataFrame, wanted: Mapping[str, str]) -> list[str]:
    return [name for name in wanted if name not in df.columns]


def fill_missing(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Exactly the wanted columns, those the frame lacks as typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in wanted.items()]
    )
