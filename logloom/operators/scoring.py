"""Benchmark scoring: sessions and trials against grades and questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.compat import blank_to_null, count_if, millis, ratio, rounded, strip
from logloom.functions.text import app_of
from logloom.operators.ordering import exact_percentile, exact_percentiles

# Fixed value: questions are matched on this many leading characters when the
# full text differs.
QUESTION_HEAD = 40


def benchmark_sessions(entries: DataFrame) -> DataFrame:
    """Per session, straight from the entries: app, model, question, calls, wall time, status.

    Unlike the session rollup, one capped or failed call anywhere marks the
    session.  `entries` are wide rows, stored and live together.
    """
    error = F.col("error")
    per_session = entries.groupBy("session_id").agg(
        F.min("origin").alias("origin"),
        F.min("model").alias("model"),
        F.max("user_question").alias("question"),
        count_if(F.col("type") == "response").alias("turns"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.coalesce(F.bool_or(error.contains("budget limit")), F.lit(False)).alias("capped"),
        F.coalesce(F.bool_or(blank_to_null(error).isNotNull()), F.lit(False)).alias("failed"),
    )
    wall = (millis("last_ts") - millis("first_ts")).cast("double") / 1000.0
    return per_session.select(
        "session_id",
        app_of(F.col("origin")).alias("app"),
        "model", "question", "turns",
        rounded(wall, 1).alias("wall_s"),
        F.when(F.col("capped"), "budget_capped").when(F.col("failed"), "error").otherwise("ok").alias("status"),
    )


def match_question(sessions: DataFrame, questions: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Adds q: the question index by exact text, else by its first 40 characters, else '?'.

    `questions` is (app, q_idx int, question).  `aliases` maps further app names
    to the app whose questions they use.
    """
    app = F.col("app")
    for name, same_as in (aliases or {}).items():
        app = F.when(F.col("app") == name, F.lit(same_as)).otherwise(app)
    asked = strip(F.coalesce(F.col("question"), F.lit("")))
    q = questions.select(F.col("app").alias("__app"), strip("question").alias("__q"), "q_idx")
    exact = q.groupBy("__app", "__q").agg(F.min("q_idx").alias("__exact"))
    close = (
        q.groupBy(F.col("__app").alias("__app2"), F.left("__q", F.lit(QUESTION_HEAD)).alias("__head"))
        .agg(F.min("q_idx").alias("__close"))
    )
    keyed = sessions.withColumn("__a", app).withColumn("__t", asked)
    found = keyed.join(exact, (F.col("__a") == F.col("__app")) & (F.col("__t") == F.col("__q")), "left").join(
        close,
        (F.col("__a") == F.col("__app2")) & (F.left("__t", F.lit(QUESTION_HEAD)) == F.col("__head")),
        "left",
    )
    index = F.coalesce("__exact", "__close")
    usable = index.isNotNull() & (F.col("__t") != "")
    return found.select(
        *sessions.columns,
        F.when(usable, F.concat(F.lit("q"), index.cast("string"))).otherwise("?").alias("q"),
    )


def attach_grades(sessions: DataFrame, grades: DataFrame) -> DataFrame:
    """Adds score by the first 8 characters of the session id; grades is (prefix, score)."""
    g = grades.groupBy("prefix").agg(F.max("score").alias("score"))
    return sessions.join(g, F.left("session_id", F.lit(8)) == F.col("prefix"), "left").drop("prefix")


def attach_cell_grades(cells: DataFrame, grades: DataFrame) -> DataFrame:
    """Adds score by (app, question, model); grades has at most one score per cell."""
    return cells.join(grades.select("app", "question", "model", "score"), ["app", "question", "model"], "left")


def trial_status(timed_out: Column, error: Column) -> Column:
    """Status of a trial from its summary row."""
    text = strip(F.coalesce(error, F.lit("")))
    return (
        F.when((F.lower(F.coalesce(timed_out, F.lit(""))) == "true") | text.contains("timed out"), "timeout")
        .when(text.contains("502") | text.contains("500"), "api_5xx")
        .when(text != "", "error")
        .otherwise("ok")
    )


def with_status(trials: DataFrame) -> DataFrame:
    return trials.withColumn("status", trial_status(F.col("timed_out"), F.col("error")))


def cell_stats(trials: DataFrame) -> DataFrame:
    """Per (app, question, model): trials, completed, latency and tool calls of the completed.

    Medians are exact and computed by the distributed percentile, since one
    cell may hold a large part of all trials.
    """
    keys = ["app", "question", "model"]
    t = with_status(trials)
    ok = t.where(F.col("status") == "ok").withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0.0)))
    counts = t.groupBy(*keys).agg(
        F.count("*").alias("n"),
        count_if(F.col("status") == "ok").alias("ok"),
        F.min(F.when(F.col("status") == "ok", F.col("elapsed_s"))).alias("lat_min"),
        F.max(F.when(F.col("status") == "ok", F.col("elapsed_s"))).alias("lat_max"),
    )
    medians = exact_percentiles(ok, keys, ["elapsed_s", "tool_calls"], 0.5)
    return counts.join(medians, keys, "left").select(
        *counts.columns, F.col("elapsed_s").alias("lat_med"), F.coalesce("tool_calls", F.lit(0.0)).alias("tools_med")
    )


def model_rollup(trials: DataFrame, cell_grades: DataFrame) -> DataFrame:
    """Per model: completion, median latency, and accuracy as the mean over graded cells."""
    t = with_status(trials)
    counts = t.groupBy("model").agg(count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("n"))
    lat = exact_percentile(t.where(F.col("status") == "ok"), ["model"], "elapsed_s", 0.5, "lat_med")
    cells = t.select("app", "question", "model").distinct()
    graded = (
        attach_cell_grades(cells, cell_grades)
        .groupBy("model")
        .agg(F.avg("score").alias("accuracy"), F.count("score").alias("graded_cells"))
    )
    return counts.join(lat, "model", "left").join(graded, "model", "left")


def model_summary(sessions: DataFrame) -> DataFrame:
    """Per model over benchmark sessions: attempts, completed, capped, accuracy, medians.

    Accuracy is the mean over graded completed sessions, 0 where none is graded.
    """
    done = F.col("status") == "ok"
    counts = sessions.groupBy("model").agg(
        F.count("*").alias("attempts"),
        count_if(done).alias("completed"),
        count_if(F.col("status") == "budget_capped").alias("capped"),
        F.coalesce(F.avg(F.when(done, F.col("score"))), F.lit(0.0)).alias("accuracy"),
    )
    ok = sessions.where(done)
    medians = exact_percentiles(ok, ["model"], ["wall_s", "turns"], 0.5)
    return counts.join(medians, "model", "left").select(
        *counts.columns,
        (F.lit(100.0) * ratio(F.col("completed"), F.col("attempts"))).alias("complete_pct"),
        F.col("wall_s").alias("median_wall_s"),
        F.col("turns").alias("median_turns"),
    )


def pivot_by_model(cells: DataFrame, value: str, models: Sequence[str], keys: Sequence[str] = ("app", "q")) -> DataFrame:
    """One column per model from one-row-per-(keys, model) cells; a gap stays NULL."""
    return cells.groupBy(*keys).pivot("model", list(models)).agg(F.max(value))


def pivot_accuracy(sessions: DataFrame, models: Sequence[str]) -> DataFrame:
    graded = sessions.where((F.col("status") == "ok") & F.col("score").isNotNull())
    return graded.groupBy("app", "q").pivot("model", list(models)).agg(F.avg("score"))


def pivot_wall(sessions: DataFrame, models: Sequence[str]) -> DataFrame:
    ok = sessions.where(F.col("status") == "ok")
    return pivot_by_model(exact_percentile(ok, ["app", "q", "model"], "wall_s", 0.5, "v"), "v", models)


def pivot_calls(sessions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per question and model 'median (max)' calls; the median is cut to a whole number."""
    ok = sessions.where(F.col("status") == "ok")
    keys = ["app", "q", "model"]
    cells = exact_percentile(ok, keys, "turns", 0.5, "med").join(ok.groupBy(*keys).agg(F.max("turns").alias("top")), keys)
    text = F.concat(F.floor("med").cast("string"), F.lit(" ("), F.col("top").cast("string"), F.lit(")"))
    return pivot_by_model(cells.withColumn("v", text), "v", models)


def matrix_cells(questions: DataFrame, models: Sequence[str], trials: int, results: DataFrame) -> DataFrame:
    """Every planned (question, model, trial) with its result; gaps read `no_transcript`.

    The grid comes from exploding the run's own parameters beside each question.
    """
    grid = questions.select(
        "app", "question",
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
    ).withColumn(
        "trial", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trials).cast("bigint")))
    )
    keys = ["app", "question", "model", "trial"]
    out = grid.join(results.withColumn("__have", F.lit(True)), keys, "left")
    missing = F.col("__have").isNull()
    return out.withColumn("error", F.when(missing, F.lit("no_transcript")).otherwise(F.col("error"))).drop("__have")


def regression_gate(baseline: DataFrame, candidate: DataFrame, targets: DataFrame) -> DataFrame:
    """Per question: old and new score, whether it got worse, whether a target is fixed.

    Questions are compared one by one; a mean would hide the ones that got worse.
    """
    return (
        baseline.select("id", F.col("score").alias("old_score"))
        .join(candidate.select("id", F.col("score").alias("new_score")), "id", "left")
        .join(targets.select("id").distinct().withColumn("__t", F.lit(True)), "id", "left")
        .select(
            "id", "old_score", "new_score",
            (F.col("new_score").isNull() | (F.col("new_score") < F.col("old_score"))).alias("regressed"),
            F.when(F.col("__t"), F.coalesce(F.col("new_score") >= 1.0, F.lit(False))).alias("target_fixed"),
        )
    )


def gate_verdict(gate: DataFrame) -> DataFrame:
    """One row: do all targets pass and is nothing worse."""
    clean = F.coalesce(F.bool_and(~F.col("regressed")), F.lit(True))
    fixed = F.coalesce(F.bool_and(F.col("target_fixed")), F.lit(True))
    return gate.agg(
        F.count("*").alias("questions"),
        count_if(F.col("regressed")).alias("regressions"),
        fixed.alias("targets_fixed"),
        (clean & fixed).alias("passed"),
    )


def trap_difficulty(questions: DataFrame) -> DataFrame:
    """Per trap rule: questions, graded ones, and mean accuracy; ungraded counted apart."""
    return (
        questions.select("id", F.explode("trap").alias("trap"), "accuracy")
        .groupBy("trap")
        .agg(
            F.count("*").alias("questions"),
            count_if(F.col("accuracy").isNull()).alias("ungraded"),
            F.avg("accuracy").alias("mean_accuracy"),
        )
    )


def hardest(questions: DataFrame, k: int = 5) -> DataFrame:
    """The k graded questions with the lowest accuracy."""
    graded = questions.where(F.col("accuracy").isNotNull())
    return graded.orderBy(F.col("accuracy").asc(), F.col("id").asc()).limit(k)


def clarify_pairs(questions: DataFrame) -> DataFrame:
    """Ambiguous questions beside their precise twins; a question without twin is kept."""
    twin = questions.select(F.col("id").alias("pairs_with"), F.col("question").alias("precise_question"), F.col("mode").alias("precise_mode"))
    vague = questions.where(F.col("mode") == "clarify").select("id", "app", "question", "pairs_with")
    return vague.join(twin, "pairs_with", "left")


def transcript_rollup(transcripts: DataFrame) -> DataFrame:
    """Per run: tool calls, model and tool time, tokens and output rate.

    All arrays belong to one run and are folded in place, without exploding.
    Tokens count only fetches that report usage; the rate is NULL without time.
    """
    def total(arr: Column, f) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(f(x).cast("double"), F.lit(0.0)))

    empty_turns = F.coalesce("turns", F.array().cast("array<struct<turn: int, type: string, name: string, arguments: string, ts: bigint, tool_exec_ms: double>>"))
    fetches = F.coalesce("llm_fetches", F.array().cast("array<struct<ms: double, ok: boolean, status: int, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>"))
    metered = F.filter(fetches, lambda f: f["usage"].isNotNull())
    completion = total(metered, lambda f: f["usage"]["completion_tokens"])
    out_ms = total(metered, lambda f: f["ms"])
    own = [c for c in transcripts.columns if c not in ("turns", "llm_fetches")]
    return transcripts.select(
        *own,
        F.size(F.filter(empty_turns, lambda t: t["type"] == "call")).cast("bigint").alias("tool_call_count"),
        total(fetches, lambda f: f["ms"]).alias("llm_total_ms"),
        total(F.filter(empty_turns, lambda t: t["type"] == "result"), lambda t: t["tool_exec_ms"]).alias("tool_total_ms"),
        total(metered, lambda f: f["usage"]["prompt_tokens"]).cast("bigint").alias("prompt_tokens_total"),
        completion.cast("bigint").alias("completion_tokens_total"),
        rounded(F.try_divide(completion, out_ms / 1000.0), 2).alias("output_tok_per_sec"),
    )


def trial_summary(runs: DataFrame) -> DataFrame:
    """The 14 summary columns of a run, ready for `write_report`."""
    def flag(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit(False)), "True").otherwise("False")

    return runs.select(
        "trial", "question", "model",
        F.col("elapsed_sec").alias("elapsed_s"),
        rounded(F.col("llm_total_ms") / 1000.0, 2).alias("llm_s"),
        rounded(F.col("tool_total_ms") / 1000.0, 2).alias("tool_s"),
        F.col("tool_call_count").alias("tool_calls"),
        F.nullif("prompt_tokens_total", F.lit(0)).alias("prompt_tok"),
        F.nullif("completion_tokens_total", F.lit(0)).alias("completion_tok"),
        F.nullif("output_tok_per_sec", F.lit(0.0)).alias("tok_per_sec"),
        flag("timed_out").alias("timed_out"),
        flag("cancelled").alias("cancelled"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.length(F.coalesce("response", F.lit(""))).alias("answer_len"),
    )
