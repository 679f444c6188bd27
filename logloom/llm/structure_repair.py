"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

The role initials of a repaired conversation read ``(s?(ua)+)?``.  A row may be kept (K, 0),
re-roled to user or assistant (R, 2) or deleted (D, 3); an empty user or assistant turn may be
inserted anywhere (I, 2).  Blank and duplicate rows must be deleted, a truncated row that stays adds 1.
Of the cheapest edits those whose initials are least in ASCII order are taken.

The method is a parallel Viterbi by rank convergence.  Rows are numbered and cut into chunks of
``CHUNK`` rows, each one line of marks.  The cost to go of the four states (nothing yet, after
system, user, assistant) is a vector; a chunk turns the vector at its end into the one at its start.
All chunks start at once from a speculative vector (the one at a conversation's end).  Fix-up passes
hand every chunk the vector its successor found and run again those for which it differs by more
than a constant; constants don't change any choice.  Chunks without a live row hand on what they get,
so a pass looks beyond them.  Some inputs never converge (rows that fit no role keep the
parity of their number): what is open after ``PASSES`` passes is stitched exactly, by the chunks'
4 by 4 cost matrices.  With the right vectors every chunk is traced from each state it may begin in;
the states are chained and the traces that apply are kept.

A chunk is bounded, whatever the conversation.  Chaining, and the digest of a repaired conversation,
read its chunks or rows as a stream in one task, in constant memory; a digest allows no other way.
The audit of a conversation is one value, as the result demands.

Cases: a null role or text is one space, so a null text is blank; null turns come first; equal turns
are ordered by role, then text; a null conv_id is a conversation of its own; repeated rows are
duplicates; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import staged, table
from logloom.operators.ordering import position

CHUNK = 1024
PASSES = 4
BUCKET_TURNS = 10  # turns are numbered in ranges of 2 to this power
BLANK_CHARS = " \t\n\x0b\f\r"
KEY = ["conv", "lone"]  # the conversation, and whether its id is null

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_BY_CLASS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
# The one state that an inserted or re-roled turn leads to, and its role.
NEXT_BY_EDIT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "u", ASSISTANT: "a"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINAL = (0, 2 * INSERT, INSERT, 0)  # cost to go at the end of a conversation
FAR = 1 << 40

Vector = tuple[int, int, int, int]

# Marks of a row, by the class of its role's initial: sound, truncated, blank.
SOUND, CUT, BLANK = "suao", "SUAO", "1234"
FIRST = "!"  # goes before the mark of a row whose content is new


def classes() -> dict[str, str]:
    return {mark: SOUND[i] for marks in (SOUND, CUT, BLANK) for i, mark in enumerate(marks)}


CLASS_OF = classes()


def read_marks(marks: str) -> list[str]:
    """One code per row: class and truncation of a live row; "-" and the fault for rows to delete."""
    out, new = [], False
    for mark in marks:
        if mark == FIRST:
            new = True
            continue
        out.append("-b" if mark in BLANK else mark if new else "-d")
        new = False
    return out


# ---- the recurrence ----------------------------------------------------------


@lru_cache(maxsize=100_000)
def _before(after: Vector, code: str) -> Vector:
    """Cost to go before a live row, from that after it."""
    own, extra = CLASS_OF[code], TRUNCATED if code in CUT else 0
    raw = []
    for state in range(4):
        cost = min(DELETE + after[state], REROLE + extra + after[NEXT_BY_EDIT[state]])
        to = NEXT_BY_CLASS[own].get(state)
        raw.append(cost if to is None else min(cost, extra + after[to]))
    for _ in range(2):  # up to two turns inserted before the row
        raw = [min(raw[s], INSERT + raw[NEXT_BY_EDIT[s]]) for s in range(4)]
    return tuple(raw)


def _levelled(vector: Vector) -> Vector:
    least = min(vector)
    return vector if least == 0 else tuple(v - least for v in vector)


@lru_cache(maxsize=100_000)
def _levelled_before(after: Vector, code: str) -> Vector:
    return _levelled(_before(after, code))


def entry_vector(codes: list[str], end: Vector) -> Vector:
    """The levelled vector at the start of a chunk."""
    vector = _levelled(end)
    for code in reversed(codes):
        if code[0] != "-":
            vector = _levelled_before(vector, code)
    return vector


def cost_matrix(codes: list[str]) -> list[int]:
    """Row by row: cost from each state at the start to each state at the end."""
    columns = []
    for to in range(4):
        vector = tuple(0 if s == to else FAR for s in range(4))
        for code in reversed(codes):
            if code[0] != "-":
                vector = _before(vector, code)
        columns.append(vector)
    return [min(columns[to][s], FAR) for s in range(4) for to in range(4)]


def through(matrix: list[int], end: Vector) -> Vector:
    return tuple(min(matrix[4 * s + to] + end[to] for to in range(4)) for s in range(4))


@lru_cache(maxsize=200_000)
def _choice(after: Vector, code: str, state: int) -> tuple[str, str, int, int]:
    """The least edits of one live row: roles inserted before it, its edit, cost and next state."""
    here, inserted, cost = _before(after, code), "", 0
    own, extra = CLASS_OF[code], TRUNCATED if code in CUT else 0
    while True:
        to = NEXT_BY_CLASS[own].get(state)
        if DELETE + after[state] == here[state]:
            return inserted, "D", cost + DELETE, state
        by_edit = NEXT_BY_EDIT[state]
        if INSERT + here[by_edit] == here[state]:
            inserted, cost, state = inserted + ROLE_OF[by_edit], cost + INSERT, by_edit
        elif to is not None and extra + after[to] == here[state]:
            return inserted, "K", cost + extra, to
        else:
            return inserted, ROLE_OF[by_edit].upper(), cost + REROLE + extra, by_edit


def trace(codes: list[str], end: Vector, state: int, last: bool) -> tuple[list[str], int, int]:
    """Edits of a chunk entered in `state`, their cost, and the state it is left in.

    An edit is the inserted roles (u, a), then K, D, U or A (re-roled); the last row of a
    conversation may have inserted roles after it.
    """
    after, vector = [], _levelled(end)
    for code in reversed(codes):
        after.append(vector)
        if code[0] != "-":
            vector = _levelled_before(vector, code)
    edits, cost = [], 0
    for code in codes:
        own = after.pop()
        if code[0] == "-":
            edits.append("D")  # before any insertion: D sorts first
            cost += DELETE
            continue
        inserted, edit, paid, state = _choice(own, code, state)
        edits.append(inserted + edit)
        cost += paid
    while last and state in (SYSTEM, USER):
        state = NEXT_BY_EDIT[state]
        edits[-1] += ROLE_OF[state]
        cost += INSERT
    return edits, cost, state


_AUDIT = str.maketrans("uaUA", "IIRR")


# ---- rows, marks and chunks --------------------------------------------------


def number_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, lone, pos (from 1), turn, role, text in the order of turns; a table of its own."""
    space = F.lit(" ")
    ready = rows.select(
        F.coalesce(F.col(conv), F.lit(0).cast(rows.schema[conv].dataType)).alias("conv"), F.col(conv).isNull().alias("lone"),
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    bucket = F.coalesce(F.shiftright("turn", BUCKET_TURNS), F.lit(-(1 << 62)))
    return staged(position(ready, KEY, order, bucket, "pos"), "repair-rows")


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """conv, lone, chunk, last, before (mark ahead of the chunk) and marks, from numbered rows."""
    kept = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    kind = F.when(kept == "", F.lit(BLANK)).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), F.lit(SOUND)).otherwise(F.lit(CUT))
    marked = rows.select(
        *KEY, "pos", F.substr(kind, place, F.lit(1)).alias("mark"),
        F.when(kept != "", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("content"),
    )
    # the first place of each content; a marker of its own, so that no row is joined by its content
    first = marked.where(F.col("content").isNotNull()).groupBy(*KEY, "content").agg(F.min("pos").alias("pos"))
    entries = marked.select(*KEY, "pos", "mark").unionByName(first.select(*KEY, "pos", F.lit(FIRST).alias("mark")))
    chunk = F.floor((F.col("pos") - 1) / size).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mark")))  # the marker sorts ahead of its row's mark
    cut = entries.groupBy(*KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(ordered, lambda e: e["mark"]), "").alias("marks"))
    by = Window.partitionBy(*KEY).orderBy("chunk")
    return staged(
        cut.select(
            *KEY, "chunk", F.lead("chunk").over(by).isNull().alias("last"), F.right(F.lag("marks").over(by), F.lit(1)).alias("before"), "marks"
        ),
        "repair-chunks",
    )


# ---- passes over chunks ------------------------------------------------------

_VECTOR = T.ArrayType(T.LongType())
_TRACED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("edits", "audit")]
    + [T.StructField(n, T.LongType()) for n in ("cost", "blank", "duplicate", "truncated", "illegal")]
)


def _vector(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


@F.pandas_udf(_VECTOR)
def _entry(marks: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([list(entry_vector(read_marks(m), tuple(int(x) for x in e))) for m, e in zip(marks, end)])


@F.pandas_udf(_VECTOR)
def _matrix(marks: pd.Series) -> pd.Series:
    return pd.Series([cost_matrix(read_marks(m)) for m in marks])


@F.pandas_udf(_VECTOR)
def _exits(marks: pd.Series, end: pd.Series) -> pd.Series:
    """The state each of the four entry states leads to."""
    return pd.Series(
        [[trace(read_marks(m), tuple(int(x) for x in e), s, False)[2] for s in range(4)] for m, e in zip(marks, end)]
    )


@F.pandas_udf(_TRACED)
def _traced(marks: pd.Series, end: pd.Series, state: pd.Series, last: pd.Series, before: pd.Series) -> pd.DataFrame:
    out = []
    for m, e, s, is_last, ahead in zip(marks, end, state, last, before):
        codes = read_marks(m)
        edits, cost, _ = trace(codes, tuple(int(x) for x in e), int(s), bool(is_last))
        roles = [CLASS_OF[x] for x in (ahead or "") + m if x != FIRST]
        out.append((
            ",".join(edits), "".join(edits).translate(_AUDIT), cost, codes.count("-b"), codes.count("-d"), sum(c in CUT for c in codes),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        ))
    return pd.DataFrame(out, columns=_TRACED.names)


def _stitch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Right end vectors from cost matrices; chunks come last first, conversation by conversation."""
    at, vector = None, FINAL
    for part in parts:
        ends = []
        for conv, lone, matrix in zip(part["conv"], part["lone"], part["matrix"]):
            if (conv, lone) != at:
                at, vector = (conv, lone), FINAL
            ends.append(list(vector))
            vector = _levelled(through([int(x) for x in matrix], vector))
        yield part.assign(end=ends)[["conv", "lone", "chunk", "last", "before", "marks", "end"]]


def _chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each chunk is entered in; chunks come in order, conversation by conversation."""
    at, state = None, START
    for part in parts:
        states = []
        for conv, lone, exits in zip(part["conv"], part["lone"], part["exits"]):
            if (conv, lone) != at:
                at, state = (conv, lone), START
            states.append(state)
            state = int(exits[state])
        yield part.assign(state=states)[["conv", "lone", "chunk", "last", "before", "marks", "end", "state"]]


def converge(cut: DataFrame, passes: int) -> DataFrame:
    """Chunks of long conversations with `end`, the vector at their end, right up to a constant."""
    start = cut.select("*", _vector(FINAL).alias("end"))
    known = staged(start.select("*", _entry("marks", "end").alias("entry")), "repair-pass")
    later = Window.partitionBy(*KEY).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # what a chunk without live rows found is only what it was given, so a pass looks beyond it
    alive = F.col("last") | F.col("marks").rlike(f"{FIRST}[{SOUND}{CUT}]")
    names = [*cut.columns, "end", "entry"]
    for _ in range(passes):
        handed = F.coalesce(F.last(F.when(alive, F.col("entry")), ignorenulls=True).over(later), _vector(FINAL))
        tested = known.select("*", handed.alias("handed")).withColumn("stale", F.col("handed") != F.col("end"))
        if tested.where("stale").isEmpty():
            return known.drop("entry")
        again = tested.where("stale").select(*cut.columns, F.col("handed").alias("end"), _entry("marks", "handed").alias("entry"))
        known = staged(tested.where("NOT stale").select(*names).unionByName(again), "repair-pass")
    streamed = known.select(*KEY, "chunk", "last", "before", "marks", _matrix("marks").alias("matrix"))
    streamed = streamed.repartition(*KEY).sortWithinPartitions(*KEY, F.col("chunk").desc())
    schema = cut.select(*KEY, "chunk", "last", "before", "marks").withColumn("end", _vector(FINAL)).schema
    return staged(streamed.mapInPandas(_stitch, schema), "repair-stitched")


def find_edits(rows: DataFrame, size: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """conv, lone, chunk, edits (comma-separated, one per row), audit, cost and counts, from numbered rows."""
    cut = chunks(rows, size)
    short = cut.where("last AND chunk = 0").select("*", _vector(FINAL).alias("end"), F.lit(START).cast("bigint").alias("state"))
    long_ = cut.where("NOT (last AND chunk = 0)")
    if not long_.isEmpty():
        ended = converge(long_, passes)
        mapped = ended.select("*", _exits("marks", "end").alias("exits"))
        streamed = mapped.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
        short = short.unionByName(streamed.mapInPandas(_chain, short.schema))
    traced = short.select(*KEY, "chunk", _traced("marks", "end", "state", "last", "before").alias("t"))
    return staged(traced.select(*KEY, "chunk", "t.*"), "repair-edits")


def _apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows; the edits of a chunk come ahead of its rows, in order, conversation by conversation."""
    names, edits = {"u": "user", "a": "assistant"}, iter(())
    for part in parts:
        out = []
        for conv, lone, given, role, text in zip(part["conv"], part["lone"], part["edits"], part["role"], part["text"]):
            if given is not None:
                edits = iter(given.split(","))
                continue
            for step in next(edits):
                if step in names:
                    out.append((conv, lone, names[step], ""))
                elif step != "D":
                    out.append((conv, lone, role if step == "K" else names[step.lower()], text))
        yield pd.DataFrame(out, columns=["conv", "lone", "role", "text"])


def repaired(rows: DataFrame, edits: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv, lone, role, text of the repaired conversations: each lies in one partition, in order."""
    none = F.lit(None).cast("string")
    chunk = F.floor((F.col("pos") - 1) / size).cast("long")
    both = rows.select(*KEY, chunk.alias("chunk"), "pos", none.alias("edits"), "role", "text").unionByName(
        edits.select(*KEY, "chunk", F.lit(0).cast("bigint").alias("pos"), "edits", none.alias("role"), none.alias("text"))
    )
    placed = both.repartition(*KEY).sortWithinPartitions(*KEY, "chunk", "pos")
    return placed.mapInPandas(_apply, rows.select(*KEY, "role", "text").schema)


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, running = None, None
    for part in parts:
        out = []
        for conv, lone, role, text in zip(part["conv"], part["lone"], part["role"], part["text"]):
            if (conv, lone) != at:
                if at is not None:
                    out.append((*at, running.hexdigest()))
                at, running = (conv, lone), sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["conv", "lone", "digest"])
    if at is not None:
        yield pd.DataFrame([(*at, running.hexdigest())], columns=["conv", "lone", "digest"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults of the query: by crc32 of "conv_id:turn" a row is dropped, emptied, cut, repeated or re-roled."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = part("text"), part("role")
    broken = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return broken.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


EMPTY_HASH = sha256(b"").hexdigest()


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = number_rows(damaged(conversations))
    edits = find_edits(rows)
    digests = repaired(rows, edits).mapInPandas(_digest, rows.select(*KEY, F.col("text").alias("digest")).schema)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
    totals = edits.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    )
    turns = rows.groupBy(*KEY).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = conversations.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("lone")).distinct()
    found = every.join(totals, KEY, "left").join(turns, KEY, "left").join(digests, KEY, "left")
    return found.select(
        F.when(~F.col("lone"), F.col("conv")).alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts)],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(EMPTY_HASH)).alias("repaired_sha256"),
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB: bit by bit, with the reflected polynomial (a fixed value)."""
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"


def _paid(value: str, cost: str, edit: str) -> str:
    return f"lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{edit}'"


def _after_row_sql() -> str:
    """The four states after one more row, inserted turns left out; a value is the cost in nine digits and the audit."""
    fits = lambda c, *v: ", ".join(f"CASE WHEN cls = '{c}' THEN {_paid(x, 'cut', 'K')} END" for x in v)
    edited = lambda *v: ", ".join(_paid(x, "2 + cut", "R") for x in v)
    live = {
        "n": _paid("n", "3", "D"),
        "s": f"least({_paid('s', '3', 'D')}, {fits('s', 'n')})",
        "u": f"least({_paid('u', '3', 'D')}, {fits('u', 'n', 's', 'a')}, {edited('n', 's', 'a')})",
        "a": f"least({_paid('a', '3', 'D')}, {fits('a', 'u')}, {edited('u')})",
    }
    return ", ".join(f"CASE WHEN dead THEN {_paid(k, '3', 'D')} ELSE {v} END AS {k}" for k, v in live.items())


_WITH_USER = f"least(u, {', '.join(_paid(x, '2', 'I') for x in 'nsa')})"

OP13_SQL = f"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) FROM raw WHERE fault <> 0)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
           regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                   WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           left(role, 1) AS cls, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
    FROM numbered
), coded AS (
    SELECT conv_id, pos, cls, coalesce(fault IN ('blank', 'duplicate'), false) AS dead, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM judged
), walked AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, '000000000' AS n, NULL::VARCHAR AS s, '000000002I' AS u, '000000004II' AS a FROM coded
    UNION ALL
    SELECT conv_id, pos, n, s, u, least(a, {_paid('u', '2', 'I')}) AS a FROM (
        SELECT conv_id, pos, n, s, a, {_WITH_USER} AS u FROM (
            SELECT w.conv_id, c.pos, {_after_row_sql()} FROM walked w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos = w.pos + 1))
), best AS (
    SELECT conv_id, least(n, a) AS found FROM walked
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), steps AS (
    SELECT conv_id, i, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS said
    FROM (SELECT conv_id, i, substr(found, i + 9, 1) AS edit FROM best, unnest(generate_series(1, length(found) - 9)) AS t(i))
    WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), spoken AS (
    SELECT s.*, j.role, j.text, bool_or(s.said = 1 AND s.edit = 'K' AND j.cls = 's') OVER (PARTITION BY s.conv_id) AS led
    FROM steps s LEFT JOIN judged j ON s.edit <> 'I' AND j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.pos = s.pos WHERE s.edit <> 'D'
), lines AS (
    SELECT conv_id, i, CASE WHEN edit = 'K' THEN role WHEN (said - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
    FROM spoken
), told AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS repaired_sha256 FROM lines GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(left(b.found, 9)::BIGINT, 0) AS cost,
       coalesce(substr(b.found, 10), '') AS audit, coalesce(t.repaired_sha256, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
