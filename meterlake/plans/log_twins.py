"""DuckDB twins of the queries over logs."""

from __future__ import annotations

from meterlake.plans import twins
from meterlake.plans.adapter import USAGE_SQL

WHOLE = "(input + cache_read + cache_creation)"
CLAUDE = """t AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN project ELSE replace(project, '/', '-') END AS place FROM u WHERE provider = 'claude')"""
ECHO = """r AS (SELECT * FROM u WHERE provider = 'codex')"""
SNAPS = """
s0 AS (SELECT *, sum(input + cache_read + cache_creation) OVER b AS ci, sum(output) OVER b AS co, sum(cache_read) OVER b AS cr, sum(cache_creation) OVER b AS cc FROM u
  WHERE provider = 'opencode' AND user_id % 2 = 1 WINDOW b AS (PARTITION BY session_id, model, ordinal // 1000 ORDER BY ordinal)),
s1 AS (SELECT *, lag(ci) OVER l AS pi, lag(co) OVER l AS po, lag(cr) OVER l AS pr, lag(cc) OVER l AS pc FROM s0 WINDOW l AS (PARTITION BY session_id, model ORDER BY ordinal)),
s2 AS (SELECT *, pi IS NULL OR ci < pi OR co < po OR cr < pr OR cc < pc AS fresh FROM s1),
s3 AS (SELECT *, (CASE WHEN fresh THEN ci ELSE ci - pi END)::bigint AS di, (CASE WHEN fresh THEN co ELSE co - po END)::bigint AS dd, (CASE WHEN fresh THEN cr ELSE cr - pr END)::bigint AS dr, (CASE WHEN fresh THEN cc ELSE cc - pc END)::bigint AS dc FROM s2)
"""
UNITED = f"""
{CLAUDE}, {ECHO}, {SNAPS}, every AS (
  SELECT 'claude' AS provider, 'message:m' || ordinal AS dedupe_key, epoch_us("at") AS at_us, session_id, model, place AS project, source_kind, 'call' AS granularity, agent, skill, input, output, cache_read, cache_creation, w5m, w1h FROM t
  UNION ALL SELECT 'claude', 'message:m' || ordinal || ':iter:0', epoch_us("at") + 1000000, session_id, 'claude-fable-5', place, source_kind, 'call', agent, skill, k, 2, 0, 0, 0, 0 FROM t WHERE ordinal % 17 = 0
  UNION ALL SELECT 'codex', 'codex-usage:v3:r' || ordinal, epoch_us("at"), session_id, model, project, 'main', 'call', NULL, NULL, input, output, cache_read, cache_creation, 0, 0 FROM r WHERE ordinal % 2 = 0
  UNION ALL SELECT 'codex', concat_ws(':', 'codex-usage:v2', session_id, {WHOLE}, cache_read, cache_creation, output, 0, {WHOLE} + output, '0:0:0:0:0', ordinal + 1), epoch_us("at"), session_id, model, project, 'main', 'call', NULL, NULL, input, output, cache_read, cache_creation, 0, 0
    FROM r a WHERE ordinal % 2 = 1 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.session_id = a.session_id AND b.ordinal % 2 = 0 AND b.ordinal < a.ordinal AND b.input = a.input AND b.output = a.output AND b.cache_read = a.cache_read AND b.cache_creation = a.cache_creation)
  UNION ALL SELECT 'grok', 'grok:p' || ordinal || ':' || model, epoch_us("at") // 1000000 * 1000000, session_id, model, NULL, 'main', 'aggregate', NULL, NULL, input, output, cache_read, cache_creation, 0, 0 FROM u WHERE provider = 'opencode' AND user_id % 2 = 0
  UNION ALL SELECT 'copilot', 'copilot:c' || ordinal || ':' || model, epoch_us("at"), session_id, model, NULL, 'main', 'aggregate', NULL, NULL, greatest(greatest(di - dr, 0) - dc, 0), dd, dr, dc, 0, 0 FROM s3
), usage AS (SELECT *, input + output + cache_read + cache_creation AS volume FROM every WHERE input + output + cache_read + cache_creation > 0)
"""
SPANS = """
c AS (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM conversations),
g AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id, span ORDER BY turn) AS gap FROM c WHERE span > 0),
n AS (SELECT conv_id, span, min(turn) AS head, max(turn) AS tail, count(*) FILTER (WHERE role = 'assistant') AS answers, coalesce(sum(gap) FILTER (WHERE role = 'assistant'), 0) AS model FROM g GROUP BY conv_id, span)
"""
MINUTES = 7 * 60_000


def _provider(name: str) -> str:
    return f"WITH {USAGE_SQL}, {UNITED} SELECT * FROM usage WHERE provider = '{name}'"


def _report(name: str) -> str:
    """A report's twin over the united logs in place of the tables."""
    body = twins.BODIES[name]
    kind, select = body if isinstance(body, tuple) else ("none", body)
    base = USAGE_SQL.replace("w AS (SELECT * FROM u WHERE", "w0 AS (SELECT * FROM u WHERE")
    day = "make_timestamp(at_us)"
    own = f"w AS (SELECT *, {day} AS \"at\", {day}::date AS d, hour({day})::int AS h FROM usage WHERE {day}::date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30')"
    cost = f", {twins.COST}" if kind == "cost" else ""
    text = f"WITH {base}, {UNITED}, {own}{cost} {select}".replace("[at]", '"at"')
    return f"SELECT * REPLACE (d::varchar AS d) FROM ({text})" if name in twins.DATED else text


def oracle_sql() -> dict[str, str]:
    day = "epoch_us(DATE '2024-03-01'::timestamp) + conv_id * 86400000000"
    return {
        "log_transcript_usage": _provider("claude"),
        "log_transcript_tools": f"WITH {USAGE_SQL}, {CLAUDE} SELECT 'tool:t' || user_id || '-' || k AS dedupe_key, min(epoch_us(\"at\")) + 1000000 AS at_us, arg_min(session_id, ordinal) AS session_id, arg_min(tool_name, ordinal) AS tool_name, arg_min(struct_pack(x := agent), ordinal).x AS subagent_type FROM t GROUP BY user_id, k",
        "log_transcript_modes": f"WITH {USAGE_SQL}, {CLAUDE} SELECT 'mode:m' || ordinal AS dedupe_key, epoch_us(\"at\") AS at_us, k % 2 = 0 AS has_thinking, k % 3 = 0 AS fast FROM t",
        "log_transcript_efforts": f"WITH {USAGE_SQL}, {CLAUDE} SELECT 'claude-effort:m' || ordinal AS dedupe_key, 'high' AS effort FROM t WHERE k % 5 = 0",
        "log_transcript_touches": f"WITH {USAGE_SQL}, {CLAUDE} SELECT session_id, min(epoch_us(\"at\")) AS first_us, max(epoch_us(\"at\")) + 1000000 AS last_us, count(*) * 2 AS touches FROM t GROUP BY session_id",
        "log_dialogue_turns": f"WITH {SPANS} SELECT 'claude-turn:' || conv_id || '-' || head AS dedupe_key, 'c' || conv_id AS session_id, {day} + tail * {MINUTES}000 AS end_us, (tail - head) * {MINUTES} AS duration_ms, 0::bigint AS wait_ms, (model * {MINUTES})::bigint AS model_ms, 'turn' AS status FROM n WHERE answers > 0 AND tail > head",
        "log_dialogue_paces": f"WITH {SPANS} SELECT 'claude-pace:' || b.conv_id || '-' || b.head AS dedupe_key, {day.replace('conv_id', 'b.conv_id')} + b.head * {MINUTES}000 AS at_us, (b.head - a.tail) * {MINUTES} AS gap_ms FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.span + 1 = b.span",
        "log_rollout_usage": _provider("codex"),
        "log_rollout_limits": f"WITH {USAGE_SQL}, {ECHO} SELECT session_id, epoch_us(\"at\") AS at_us, least(k + 20, 100)::double AS used_percent FROM r",
        "log_rollout_durations": f"WITH {USAGE_SQL}, {ECHO} SELECT session_id, epoch_us(\"at\") AS at_us, duration_ms FROM r WHERE duration_ms > 0",
        "log_update_usage": _provider("grok"),
        "log_snapshot_usage": _provider("copilot"),
        "log_daily_usage": _report("daily_usage"),
        "log_model_stats": _report("model_stats"),
        "log_session_bounds": _report("session_day_bounds"),
        "log_file_scan": f"WITH {USAGE_SQL}, {CLAUDE}, x AS (SELECT user_id, ordinal * 2 + unnest([0, 1]) AS n FROM t) SELECT count(DISTINCT user_id) AS files, count(*) AS lines, count(*) FILTER (WHERE n % 13 = 0) AS parse_errors FROM x",
    }
