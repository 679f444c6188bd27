"""Text columns: caps, previews, origins and error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal the log format this package reads.
PREVIEW_CHARS = 200
USER_QUESTION_MAX = 2000
TOOL_RESULT_MAX = 20000


def cap(c: Column, limit: int) -> Column:
    """First `limit` characters; a limit of 0 or less keeps the whole text."""
    text = F.coalesce(c, F.lit(""))
    return F.left(text, F.lit(limit)) if limit > 0 else text


def preview(c: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Shortened text that says how much was cut off."""
    rest = (F.length(c) - F.lit(limit)).cast("string")
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…(+"), rest, F.lit(" chars)"))
    ).otherwise(c)


def _shorten(c: Column, dtype: T.DataType, limit: int) -> Column:
    if isinstance(dtype, T.StringType):
        return preview(c, limit)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _shorten(x, dtype.elementType, limit))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _shorten(v, dtype.valueType, limit))
    if isinstance(dtype, T.StructType):
        fields = [_shorten(c[f.name], f.dataType, limit).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def compact_view(df: DataFrame, limit: int = PREVIEW_CHARS, drop: tuple[str, ...] = ("messages",)) -> DataFrame:
    """Every string of the frame, at any depth, shortened; full prompts dropped."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    return df.select(*[_shorten(F.col(f.name), f.dataType, limit).alias(f.name) for f in kept])


def app_of(origin: Column) -> Column:
    """First host label of an origin URL ('' when it is not a URL)."""
    return F.regexp_extract(origin, r"^https?://([^./:]+)", 1)


def run_tag_of(origin: Column) -> Column:
    """URL path of an origin, NULL when there is none."""
    return F.nullif(F.regexp_extract(origin, r"^https?://[^/]+(/.*)$", 1), F.lit(""))


def http_code(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"returned (\d{3})", 1), F.lit(""))


def classify_error(error: Column) -> Column:
    """Class of an error text; NULL stays NULL."""
    code = http_code(error)
    return (
        F.when(error.isNull() | (error == ""), F.lit(None).cast("string"))
        .when(error.ilike("%timed out%"), F.lit("timeout"))
        .when(code.isNotNull(), F.concat(F.lit("http_"), code))
        .when(error.ilike("client disconnected%"), F.lit("disconnected"))
        .when(error.ilike("%api key not configured%"), F.lit("not_configured"))
        .when(error.ilike("unknown model %"), F.lit("unrouted"))
        .when(error.ilike("streaming is not supported%"), F.lit("streaming_unsupported"))
        .otherwise(F.lit("connection"))
    )


def is_budget_error(error: Column) -> Column:
    # The three phrases by which providers report a spent budget.
    phrases = ("budget limit exceeded", "credit balance is too low", "requires more credits")
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | error.ilike(f"%{phrase}%")
    return hit
