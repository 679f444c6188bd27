"""Chat formatting from event logs: reconstruct the final messages, then render them with a loss mask.

A conversation log holds events.  ``message`` opens a message with a role and, perhaps, a
text; ``delta`` appends streamed text; ``edit`` replaces the text so far; ``regenerate``
discards it, and later deltas write it anew.  Any other kind is ignored.  The log is
partitioned by conversation once; messages are folded and rendered inside that partitioning.

Everything is built-in functions.  One conversation is one output record, so its messages
meet in one row; a single message's deltas likewise.

Cases: a null text or role counts as empty; a null sequence number sorts first; events with
equal numbers are ordered by kind (openings first), role and text, so ties and repeated rows
have one result; a message that never opened is its deltas with an empty role; a message
without events other than ignored ones does not exist; an empty log gives no rows; columns
other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import string_or_empty, table

KINDS = ("message", "edit", "regenerate", "delta")
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"

# Every character that can begin a control string ("<|turn|>", "</s>", "[INST]") and the escape
# character itself is followed by a backslash in an escaped text, so no control string of two
# or more characters survives inside one, and undoing it is a single left-to-right pass.
SPECIAL = r"([<\[\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL + r"\\", "$1")


def _escape_role(role: Column) -> Column:
    """A role sits on the marker's line; "<n" cannot come from `escape` and stands for a line feed."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def fold_events(
    events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message_id",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """Final messages: conv_id, messages (array of place, role, text in order)."""
    log = events.select(
        F.col(conv).alias("conv_id"), F.col(message).alias("message"), F.col(seq).alias("seq"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind)).alias("rank"),
        string_or_empty(F.col(role)).alias("role"), string_or_empty(F.col(text)).alias("text"),
    ).where("rank > 0")
    folded = (
        log.repartition("conv_id")  # also serves the two groupings below
        .groupBy("conv_id", "message")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "rank", "role", "text"))).alias("events"))
        .withColumn(
            "from", F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["rank"] < 4, i))), F.lit(0))
        )
        .select(
            "conv_id",
            F.col("events")[0]["seq"].alias("place"),
            F.coalesce(
                F.get(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r != ""), F.lit(0)), F.lit("")
            ).alias("role"),
            F.array_join(
                F.transform(F.slice("events", F.col("from") + 1, F.size("events")), lambda e: e["text"]), ""
            ).alias("text"),
        )
    )
    return folded.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("messages")
    )


def render(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points of `formatted`).

    The spans cover the escaped text of every message whose role is `trained_role`; markers
    and the other messages are outside the mask.
    """
    parts = F.transform(
        "messages",
        lambda m: F.struct(
            (m["role"] == trained_role).alias("trained"),
            F.concat(F.lit(OPEN), _escape_role(m["role"]), F.lit(MIDDLE)).alias("head"),
            escape(m["text"]).alias("body"),
        ),
    )
    measured = conversations.select("conv_id", parts.alias("parts")).withColumn(
        "sizes",
        F.transform(
            "parts",
            lambda p: F.struct(
                F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body"), p["trained"].alias("trained")
            ),
        ),
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )
    walked = F.aggregate(
        "sizes", zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(CLOSE)).alias("at"),
            F.when(
                s["trained"],
                F.array_append(
                    acc["spans"],
                    F.struct((acc["at"] + s["head"]).alias("start"), s["body"].cast("long").alias("length")),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return measured.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        walked["spans"].alias("loss_spans"),
    )


def format_chats(events: DataFrame, **columns: str) -> DataFrame:
    """Event log to rendered conversations: conv_id, formatted, loss_spans."""
    return render(fold_events(events, **columns))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(
                F.substr(p, F.char_length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1)
            ).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text below the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: an opening and one streamed delta per row.

    Every row is a message of its own, repeated rows included.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message_id"))
    return rows.select(
        "conv_id", "message_id",
        F.explode(
            F.array(
                F.struct(F.lit("message").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text")),
            )
        ).alias("event"),
        F.col("turn").alias("seq"),
    ).select("conv_id", "message_id", "seq", "event.*")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    rendered = format_chats(conversation_events(conversations.unionByName(probe)))
    read = rendered.select(
        "conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), lengths AS (
    SELECT *, length(regexp_replace(role, '([<\[\\])', '\1\\', 'g'))
           + length(role) - length(replace(role, chr(10), ''))
           + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + {len(OPEN) + len(MIDDLE) + len(CLOSE)} AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id
"""
