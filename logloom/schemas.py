"""Column lists and types of every tier, and of the raw JSON bodies."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw log lines are read with an all-text schema: the typed columns are cast
# afterwards, so that one unreadable value is NULL and not a lost line.
ENTRY_TEXT_FIELDS = (
    "timestamp", "type", "request_id", "session_id", "origin", "client", "provider", "model",
    "message_count", "tools_count", "enable_thinking", "user_question", "user_message_this_turn",
    "latency_ms", "has_tool_calls", "has_content", "tool_calls", "tool_results_this_turn",
    "tokens", "error",
)
ENTRY_TEXT = T.StructType([T.StructField(n, T.StringType()) for n in ENTRY_TEXT_FIELDS])

LEGACY_COLUMNS = ("ts", "type", "request_id", "origin", "entry")

WIDE_COLUMNS = (
    "ts", "type", "request_id", "session_id", "origin", "client", "provider", "model",
    "message_count", "tools_count", "enable_thinking", "user_question", "user_message_this_turn",
    "latency_ms", "has_tool_calls", "has_content", "tool_calls", "tool_results", "tokens",
    "error", "entry",
)
# The newest wide column: a table without it is stale whatever else it holds.
SENTINEL_COLUMN = "user_message_this_turn"

TURN_COLUMNS = (
    "session_key", "session_id", "turn_idx", "request_ts", "response_ts", "request_id", "origin",
    "client", "provider", "model", "user_question", "user_message_this_turn", "message_count",
    "enable_thinking", "tool_results", "assistant_content", "reasoning_content", "tool_calls",
    "has_tool_calls", "has_content", "latency_ms", "tokens", "error",
)

# What a session rollup needs from the turn table, with the type an absent
# column is filled with.
ROLLUP_INPUTS = {
    "session_key": "string", "session_id": "string", "turn_idx": "bigint",
    "request_ts": "timestamp", "response_ts": "timestamp", "origin": "string",
    "client": "string", "provider": "string", "model": "string", "user_question": "string",
    "user_message_this_turn": "string", "assistant_content": "string", "tool_calls": "string",
    "latency_ms": "bigint", "tokens": "string", "error": "string",
}

ROLLUP_COLUMNS = (
    "session_key", "session_id", "session_key_synthetic", "origin", "app", "run_tag", "client",
    "model", "provider", "models_used", "question", "turns", "tool_calls_total", "prompt_tokens",
    "completion_tokens", "cached_tokens", "total_tokens", "cost_usd", "cost_turns",
    "llm_ms_total", "wall_clock_s", "error_turns", "unanswered_turns", "status", "final_error",
    "final_answer", "started_at", "finished_at",
)

TOKENS_TEXT = (
    "prompt_tokens string, completion_tokens string, total_tokens string, "
    "prompt_tokens_details struct<cached_tokens: string>, cost string"
)
TOOL_CALLS = "array<struct<name: string, arguments: string>>"

MESSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("tool_call_id", T.StringType()),
        ]
    )
)

RESPONSE_BODY = (
    "choices array<struct<message: struct<content: string, reasoning_content: string, "
    "reasoning: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>>, "
    "usage string"
)

TRIAL_SUMMARY = (
    "trial int, question string, model string, elapsed_s double, llm_s double, tool_s double, "
    "tool_calls double, prompt_tok bigint, completion_tok bigint, tok_per_sec double, "
    "timed_out string, cancelled string, error string, answer_len bigint"
)

TRANSCRIPT = (
    "model string, trial int, question string, origin string, started_at string, finished_at string, "
    "turns array<struct<turn: int, type: string, name: string, arguments: string, ts: bigint, "
    "tool_exec_ms: double>>, "
    "llm_fetches array<struct<ms: double, ok: boolean, status: int, "
    "usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>, "
    "elapsed_sec double, response string, error string, timed_out boolean, cancelled boolean"
)

PROVIDER_CONFIG = (
    "providers map<string, struct<endpoint: string, models: array<string>, model_prefixes: array<string>, "
    "thinking_models: map<string, string>, no_sampling_params: array<string>>>, default_provider string"
)

GOLDEN_MANIFEST = (
    "version string, n_questions int, n_answer int, n_clarify int, "
    "questions array<struct<id: string, app: string, q_idx: string, question: string, mode: string, "
    "gold: string, accept: string, trap: array<string>, sql_ref: string, bench_mean_acc: double, "
    "note: string, ambiguity: string, pairs_with: string, resolution: string>>"
)
