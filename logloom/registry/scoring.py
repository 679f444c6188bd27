"""Queries that score benchmark sessions and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.compat import rounded
from logloom import fixtures as fx
from logloom.operators import scoring
from logloom.operators.flatten import flatten_entries
from logloom.registry.base import FLAT, LOG, query, with_ctes
from logloom.sources.bench import number_questions
from logloom.sources.tiers import report_text

MODELS = ("click", "error", "purchase", "signup", "view")
STATUS_SQL = """CASE WHEN lower(timed_out) = 'true' OR contains(error, 'timed out') THEN 'timeout'
  WHEN contains(error, '502') OR contains(error, '500') THEN 'api_5xx' WHEN error <> '' THEN 'error' ELSE 'ok' END"""
TRIALS = f"trials AS (SELECT *, {STATUS_SQL} AS status FROM ({fx.TRIALS}) raw_trials)"

# Sessions of the log, their questions and their grades.
BENCH = """bench AS (
  SELECT session_id, regexp_extract(min(origin), '^https?://([^./:]+)', 1) AS app, min(model) AS model, max(user_question) AS question,
    count(*) FILTER (WHERE type = 'response') AS turns, round(cast(date_diff('ms', min(ts), max(ts)) AS double) / 1000, 1) AS wall_s,
    CASE WHEN coalesce(bool_or(contains(error, 'budget limit')), false) THEN 'budget_capped'
      WHEN coalesce(bool_or(error <> ''), false) THEN 'error' ELSE 'ok' END AS status
  FROM flat GROUP BY session_id)"""
QUESTIONS = """SELECT DISTINCT concat('app', cast(user_id % 4 AS varchar(20))) AS app, cast(user_id % 7 + 1 AS int) AS q_idx,
  concat('q', cast(user_id % 7 AS varchar(20))) AS question FROM events """
GRADES = """SELECT DISTINCT concat('s', cast(user_id AS varchar(20))) AS prefix,
  CASE WHEN user_id % 8 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 1.0 WHEN user_id % 3 = 1 THEN 0.5 ELSE 0.0 END AS score FROM events """
# One session per event, so that every status and score occurs; one model never
# meets one question, which leaves empty cells.
GRID = """SELECT concat('app', cast(user_id % 4 AS varchar(20))) AS app, CASE WHEN event_type = 'view' AND user_id % 7 = 3 THEN 'q0' ELSE concat('q', cast(user_id % 7 AS varchar(20))) END AS q, event_type AS model,
  event_id % 9 + 1 AS turns, value AS wall_s,
  CASE WHEN event_id % 10 = 0 THEN 'budget_capped' WHEN event_id % 10 = 1 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 1.0 WHEN event_id % 4 = 1 THEN 0.5 WHEN event_id % 4 = 2 THEN 0.0 ELSE NULL END AS score
FROM events """


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, fx.TRIALS, "events").withColumn("score", F.col("score").cast("double"))


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.benchmark_sessions(flatten_entries(fx.legacy_entries(spark, sf_dir)))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run_view(spark, sf_dir, GRID, "events").withColumn("score", F.col("score").cast("double"))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


@query("benchmark_sessions", with_ctes(LOG, FLAT, BENCH, body="SELECT * FROM bench"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir)


@query(
    "benchmark_report_sessions",
    with_ctes(
        LOG, FLAT, BENCH, f"questions AS ({QUESTIONS})", f"grades AS ({GRADES})",
        body="""SELECT b.session_id, b.app, b.model, b.question, b.turns, b.wall_s, b.status, coalesce('q' || q.q_idx, '?') AS q, cast(g.score AS double) AS score
          FROM bench b LEFT JOIN questions q ON q.app = b.app AND q.question = b.question LEFT JOIN grades g ON g.prefix = left(b.session_id, 8)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = fx.run_view(spark, sf_dir, QUESTIONS, "events")
    grades = fx.run_view(spark, sf_dir, GRADES, "events").withColumn("score", F.col("score").cast("double"))
    return scoring.attach_grades(scoring.match_question(_bench(spark, sf_dir), questions), grades)


@query(
    "attach_grades",
    with_ctes(
        LOG, FLAT, BENCH, f"grades AS ({GRADES})",
        body="""SELECT status, count(*) AS sessions, count(g.score) AS graded, cast(sum(g.score) AS double) AS total
          FROM bench b LEFT JOIN grades g ON g.prefix = left(b.session_id, 8) GROUP BY status""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = fx.run_view(spark, sf_dir, GRADES, "events").withColumn("score", F.col("score").cast("double"))
    graded = scoring.attach_grades(_bench(spark, sf_dir), grades)
    return graded.groupBy("status").agg(F.count("*").alias("sessions"), F.count("score").alias("graded"), F.sum("score").alias("total"))


# The same text, a text with another ending, a text with another beginning, and
# an alias app, against the passages as questions.
ASKED = """SELECT concat('d', cast(item_id AS varchar(20))) AS sid, 'bench' AS app, text AS question FROM benchmark 
  UNION ALL SELECT concat('e', cast(item_id AS varchar(20))), 'bench', concat(substr(text, 1, 45), ' and so on') FROM benchmark 
  UNION ALL SELECT concat('f', cast(item_id AS varchar(20))), 'bench', concat('why ', text) FROM benchmark 
  UNION ALL SELECT concat('g', cast(item_id AS varchar(20))), 'bench-v2', concat('  ', text, ' ') FROM benchmark 
  UNION ALL SELECT concat('h', cast(item_id AS varchar(20))), 'other', text FROM benchmark """
PASSAGES = "SELECT 'bench' AS app, cast(item_id + 1 AS int) AS q_idx, text AS question FROM benchmark "


@query(
    "match_question",
    with_ctes(
        f"asked AS ({ASKED})", f"passages AS ({PASSAGES})",
        "a AS (SELECT *, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS t, CASE WHEN app = 'bench-v2' THEN 'bench' ELSE app END AS same FROM asked)",
        "p AS (SELECT app, q_idx, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS t FROM passages)",
        body="""SELECT sid, app, question, coalesce(concat('q', coalesce((SELECT min(q_idx) FROM p WHERE p.app = a.same AND p.t = a.t),
          (SELECT min(q_idx) FROM p WHERE p.app = a.same AND left(p.t, 40) = left(a.t, 40)))::varchar), '?') AS q FROM a""".replace(
            "coalesce(concat('q', coalesce(", "coalesce('q' || coalesce("
        ).replace("::varchar), '?')", "::varchar, '?')"),
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.run_view(spark, sf_dir, ASKED, "benchmark")
    return scoring.match_question(asked, fx.run_view(spark, sf_dir, PASSAGES, "benchmark"), {"bench-v2": "bench"})


@query("trial_status", with_ctes(TRIALS, body="SELECT app, status, count(*) AS n FROM trials GROUP BY app, status"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_status(_trials(spark, sf_dir)).groupBy("app", "status").agg(F.count("*").alias("n"))


@query(
    "cell_stats",
    with_ctes(
        TRIALS,
        body="""SELECT app, question, model, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok,
          min(elapsed_s) FILTER (WHERE status = 'ok') AS lat_min, max(elapsed_s) FILTER (WHERE status = 'ok') AS lat_max,
          round(quantile_cont(elapsed_s, 0.5) FILTER (WHERE status = 'ok'), 6) AS lat_med,
          coalesce(quantile_cont(tool_calls, 0.5) FILTER (WHERE status = 'ok'), 0.0) AS tools_med FROM trials GROUP BY 1, 2, 3""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.cell_stats(_trials(spark, sf_dir)), 6, "lat_med")


# The last graded trial of a cell gives the cell's grade; some cells stay ungraded.
CELL_GRADES = "SELECT app, question, model, max(score) AS score FROM ({trials}) t WHERE question <> 'q5' GROUP BY app, question, model"


@query(
    "model_rollup",
    with_ctes(
        TRIALS, f"grades AS ({CELL_GRADES.format(trials='SELECT * FROM trials')})",
        """g AS (SELECT model, round(avg(cast(score AS double)), 6) AS accuracy, count(score) AS graded_cells
             FROM (SELECT DISTINCT app, question, model FROM trials) c LEFT JOIN grades USING (app, question, model) GROUP BY model)""",
        body="""SELECT model, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) AS n,
          round(quantile_cont(elapsed_s, 0.5) FILTER (WHERE status = 'ok'), 6) AS lat_med, any_value(accuracy) AS accuracy, any_value(graded_cells) AS graded_cells
          FROM trials JOIN g USING (model) GROUP BY model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _trials(spark, sf_dir)
    grades = trials.where(F.col("question") != "q5").groupBy("app", "question", "model").agg(F.max("score").alias("score"))
    return _rounded(scoring.model_rollup(trials, grades), 6, "lat_med", "accuracy")


@query(
    "model_summary",
    with_ctes(
        f"grid AS ({GRID})",
        body="""SELECT model, count(*) AS attempts, count(*) FILTER (WHERE status = 'ok') AS completed, count(*) FILTER (WHERE status = 'budget_capped') AS capped,
          round(coalesce(avg(cast(score AS double)) FILTER (WHERE status = 'ok'), 0.0), 6) AS accuracy,
          round(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS complete_pct,
          round(quantile_cont(wall_s, 0.5) FILTER (WHERE status = 'ok'), 6) AS median_wall_s,
          cast(quantile_cont(turns, 0.5) FILTER (WHERE status = 'ok') AS double) AS median_turns FROM grid GROUP BY model""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.model_summary(_grid(spark, sf_dir)), 6, "accuracy", "complete_pct", "median_wall_s")


def _pivot_sql(cell: str) -> str:
    columns = ", ".join(f"{cell.format(m=m)} AS {m}" for m in MODELS)
    return with_ctes(f"grid AS (SELECT * FROM ({GRID}) x WHERE status = 'ok')", body=f"SELECT app, q, {columns} FROM grid GROUP BY app, q")


@query(
    "pivot_accuracy",
    _pivot_sql("round(avg(cast(score AS double)) FILTER (WHERE model = '{m}'), 6)"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.pivot_accuracy(_grid(spark, sf_dir), MODELS), 6, *MODELS)


@query("pivot_wall", _pivot_sql("round(quantile_cont(wall_s, 0.5) FILTER (WHERE model = '{m}'), 6)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.pivot_wall(_grid(spark, sf_dir), MODELS), 6, *MODELS)


@query(
    "pivot_calls",
    _pivot_sql(
        "cast(floor(quantile_cont(turns, 0.5) FILTER (WHERE model = '{m}')) AS bigint)::varchar || ' (' || (max(turns) FILTER (WHERE model = '{m}'))::varchar || ')'"
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pivot_calls(_grid(spark, sf_dir), MODELS)


PLANNED_TRIALS = 30


@query(
    "matrix_cells",
    with_ctes(
        TRIALS,
        "res AS (SELECT app, question, model, trial_id % 30 + 1 AS trial, max(elapsed_s) AS elapsed_s, max(error) AS error FROM trials GROUP BY 1, 2, 3, 4)",
        f"""plan AS (SELECT app, question, unnest([{', '.join(f"'{m}'" for m in MODELS)}]) AS model FROM (SELECT DISTINCT app, question FROM trials) q)""",
        f"cells AS (SELECT *, unnest(range(1, {PLANNED_TRIALS + 1})) AS trial FROM plan)",
        body="""SELECT app, question, model, trial, elapsed_s, CASE WHEN res.elapsed_s IS NULL THEN 'no_transcript' ELSE res.error END AS error
          FROM cells LEFT JOIN res USING (app, question, model, trial)""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _trials(spark, sf_dir)
    results = trials.groupBy("app", "question", "model", (F.col("trial_id") % 30 + 1).alias("trial")).agg(
        F.max("elapsed_s").alias("elapsed_s"), F.max("error").alias("error")
    )
    return scoring.matrix_cells(trials.select("app", "question").distinct(), MODELS, PLANNED_TRIALS, results)


GATE = """old AS (SELECT doc_id AS id, cast(quality AS double) AS score FROM labels),
new AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END AS score FROM labels WHERE quality = 1 OR toxic = 0),
target AS (SELECT doc_id AS id FROM labels WHERE quality = 0)"""
GATE_ROWS = """SELECT id, o.score AS old_score, cast(n.score AS double) AS new_score, n.score IS NULL OR n.score < o.score AS regressed,
  CASE WHEN t.id IS NOT NULL THEN coalesce(n.score >= 1, false) END AS target_fixed
  FROM old o LEFT JOIN new n USING (id) LEFT JOIN target t USING (id)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    old = labels.select("id", F.col("quality").cast("double").alias("score"))
    new = labels.where((F.col("quality") == 1) | (F.col("toxic") == 0)).select("id", F.when(F.col("toxic") == 1, 0.0).otherwise(1.0).alias("score"))
    return scoring.regression_gate(old, new, labels.where(F.col("quality") == 0))


@query("regression_gate", with_ctes(GATE, body=GATE_ROWS))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query(
    "gate_verdict",
    with_ctes(
        GATE, f"g AS ({GATE_ROWS})",
        body="""SELECT count(*) AS questions, count(*) FILTER (WHERE regressed) AS regressions, bool_and(target_fixed) AS targets_fixed,
          bool_and(NOT regressed) AND bool_and(target_fixed) AS passed FROM g""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gate_verdict(_gate(spark, sf_dir))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions that guard two rules each, with a score where labelled."""
    docs, labels = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.array("lang", "source").alias("trap"), F.col("quality").cast("double").alias("accuracy")
    )


@query(
    "trap_difficulty",
    """WITH d AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
      x AS (SELECT lang AS trap, quality FROM d UNION ALL SELECT source, quality FROM d)
      SELECT trap, count(*) AS questions, count(*) - count(quality) AS ungraded, round(avg(quality), 6) AS mean_accuracy FROM x GROUP BY trap""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.trap_difficulty(_guarded(spark, sf_dir)), 6, "mean_accuracy")


@query(
    "hardest_k",
    with_ctes(
        TRIALS,
        body="""SELECT concat(app, '-', question) AS id, round(avg(cast(score AS double)), 6) AS accuracy FROM trials
          WHERE question <> 'q4' GROUP BY 1 ORDER BY accuracy, id LIMIT 5""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = F.when(F.col("question") != "q4", F.col("score"))
    per_question = _trials(spark, sf_dir).groupBy(F.concat("app", F.lit("-"), "question").alias("id")).agg(rounded(F.avg(graded), 6).alias("accuracy"))
    return scoring.hardest(per_question, 5)


CLARIFY = """SELECT cast(doc_id AS varchar(20)) AS id, source AS app, text AS question, CASE WHEN doc_id % 10 = 0 THEN 'clarify' ELSE 'answer' END AS mode,
  CASE WHEN doc_id % 10 = 0 AND doc_id % 20 <> 0 THEN cast(doc_id + 1 AS varchar(20)) ELSE NULL END AS pairs_with FROM documents """


@query(
    "clarify_pairs",
    with_ctes(
        f"qs AS ({CLARIFY})",
        body="""SELECT v.id, v.app, v.question, v.pairs_with, t.question AS precise_question, t.mode AS precise_mode
          FROM qs v LEFT JOIN qs t ON t.id = v.pairs_with WHERE v.mode = 'clarify'""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.clarify_pairs(fx.run_view(spark, sf_dir, CLARIFY, "documents"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event: a call, a timed result, for some a second call, and two fetches."""
    e = fx.table(spark, sf_dir, "events")
    n = F.col("event_id")
    turn = "struct<turn: int, type: string, name: string, arguments: string, ts: bigint, tool_exec_ms: double>"
    fetch = "struct<ms: double, ok: boolean, status: int, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>"

    def one(kind: str, ms) -> F.Column:
        return F.struct(F.lit(1), F.lit(kind), F.lit("query"), F.lit("{}"), n, ms).cast(turn)

    none = F.lit(None).cast("double")
    turns = F.array(one("call", none), one("result", (n % 50).cast("double")))
    turns = F.when(n % 3 == 0, F.concat(turns, F.array(one("call", none)))).otherwise(turns)
    usage = F.when(n % 4 != 0, F.struct((n % 700).cast("bigint"), (n % 90).cast("bigint")))
    fetches = F.array(
        F.struct(F.floor(F.col("value") * 10).cast("double"), F.lit(True), F.lit(200), usage).cast(fetch),
        F.struct((n % 60).cast("double"), F.lit(False), F.lit(500), F.lit(None)).cast(fetch),
    )
    return e.select(
        n.alias("run_id"), F.col("event_type").alias("model"), (n % 3).cast("int").alias("trial"), F.lit("q").alias("question"),
        F.when(n % 10 != 0, turns).alias("turns"), fetches.alias("llm_fetches"), F.col("value").alias("elapsed_sec"),
        F.col("props").alias("response"), F.when(n % 6 == 0, F.lit("a\tb\nc")).alias("error"),
        (n % 7 == 0).alias("timed_out"), F.lit(None).cast("boolean").alias("cancelled"),
    )


RUNS = """runs AS (SELECT event_id AS run_id, event_type AS model, CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS tool_call_count,
  cast(floor(value * 10) AS double) + event_id % 60 AS llm_total_ms, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE cast(event_id % 50 AS double) END AS tool_total_ms,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 700 ELSE 0 END AS prompt_tokens_total, CASE WHEN event_id % 4 <> 0 THEN event_id % 90 ELSE 0 END AS completion_tokens_total,
  CASE WHEN event_id % 4 <> 0 AND floor(value * 10) > 0 THEN round(cast(event_id % 90 AS double) / (floor(value * 10) / 1000), 2) END AS output_tok_per_sec, value, props, event_id
  FROM events)"""


@query(
    "transcript_rollup",
    with_ctes(
        RUNS,
        body="""SELECT run_id, model, cast(tool_call_count AS bigint) AS tool_call_count, llm_total_ms, cast(tool_total_ms AS double) AS tool_total_ms, prompt_tokens_total,
          completion_tokens_total, output_tok_per_sec FROM runs""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.transcript_rollup(_transcripts(spark, sf_dir))
    return got.select(
        "run_id", "model", "tool_call_count", "llm_total_ms", "tool_total_ms", "prompt_tokens_total", "completion_tokens_total", "output_tok_per_sec"
    )


@query(
    "trial_summary",
    with_ctes(
        RUNS,
        body="""SELECT model, cast(event_id % 3 AS integer) AS trial, 'q' AS question, value AS elapsed_s, round(llm_total_ms / 1000, 2) AS llm_s,
          cast(round(tool_total_ms / 1000, 2) AS double) AS tool_s, cast(tool_call_count AS bigint) AS tool_calls, nullif(prompt_tokens_total, 0) AS prompt_tok,
          nullif(completion_tokens_total, 0) AS completion_tok, nullif(output_tok_per_sec, 0.0) AS tok_per_sec,
          CASE WHEN event_id % 7 = 0 THEN 'True' ELSE 'False' END AS timed_out, 'False' AS cancelled,
          CASE WHEN event_id % 6 = 0 THEN 'a b c' ELSE '' END AS error, cast(length(props) AS integer) AS answer_len FROM runs""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_text(scoring.trial_summary(scoring.transcript_rollup(_transcripts(spark, sf_dir))))


@query(
    "report_text",
    "SELECT doc_id, left(translate(text, chr(9) || chr(10), '  '), 100) AS error FROM documents",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_text(fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("error")))


@query(
    "number_questions",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
      s AS (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS question FROM l)
      SELECT cast(doc_id AS varchar) AS app, cast(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS integer) AS q_idx, question FROM s
      WHERE question <> '' AND NOT starts_with(question, '#')""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return number_questions(docs.select(F.col("doc_id").cast("string").alias("app"), "text"))
