"""Reports over the tagged events of several agents' logs, with twins over the driver's tables."""

from __future__ import annotations

from datetime import date

from meterlake.plans import log_twins, logs, reports, streams, work_logs
from meterlake.plans.adapter import USAGE_SQL, WINDOW, Stream, Window
from meterlake.plans.logs import HOME

#: The conversations' transcripts begin in March.
LATER = Window(date(2024, 3, 2), date(2024, 12, 31), date(2023, 5, 2))


def _stream(spark, sf_dir, lines, kinds: tuple[str, ...], window: Window = WINDOW) -> Stream:
    """The stream of the kinds that a report reads; any other would be refused."""
    return streams.from_lines({p: made(spark, sf_dir) for p, made in lines.items()}, HOME, window, kinds=kinds)


def stream_tools(spark, sf_dir):
    """Calls of tools in transcripts and rollouts, shells by their commands."""
    return reports.tool_stats(spark, _stream(spark, sf_dir, {"claude": logs.transcript_lines, "codex": work_logs.work_lines}, ("tool",)))


def stream_turn_length(spark, sf_dir):
    """Turns of rollouts and of completed updates."""
    return reports.turn_length(spark, _stream(spark, sf_dir, {"codex": work_logs.work_lines, "grok": logs.update_lines}, ("turn",)))


def stream_daily_sessions(spark, sf_dir):
    """Sessions touched on each day in the logs of four agents."""
    made = {"claude": logs.transcript_lines, "codex": logs.rollout_lines, "grok": logs.update_lines, "copilot": logs.snapshot_lines}
    return reports.daily_sessions(spark, _stream(spark, sf_dir, made, ("touch",)))


def stream_modes(spark, sf_dir):
    """Thinking and fast answers, efforts and permissions."""
    return reports.modes_summary(spark, _stream(spark, sf_dir, {"claude": logs.transcript_lines, "codex": logs.rollout_lines}, ("mode", "effort", "permission")))


def stream_limits(spark, sf_dir):
    return reports.limits_history(spark, _stream(spark, sf_dir, {"codex": logs.rollout_lines}, ("limit", "usage", "touch")))


def stream_paces(spark, sf_dir):
    """Pauses before the next prompt in the conversations' transcripts."""
    return reports.pace_stats(spark, _stream(spark, sf_dir, {"claude": logs.dialogue_lines}, ("pace",), LATER))


def oracle_sql() -> dict[str, str]:
    days = f"DATE '{WINDOW.start}' AND DATE '{WINDOW.end}'"
    at = lambda c: f"make_timestamp({c})::date"
    logged, worked = log_twins.oracle_sql(), work_logs.oracle_sql()
    names = " ".join(f"WHEN {n} THEN '{name or 'exec_command'}'" for n, (_, name) in enumerate(work_logs.CALLS))
    return {
        "stream_tools": f"""WITH a AS ({logged["log_transcript_tools"]}), b AS (
            WITH {USAGE_SQL}, e AS (SELECT *, epoch_us("at") + 21000000 AS t, CASE WHEN k % 2 = 0 THEN CASE ordinal % {len(work_logs.CALLS)} {names} END ELSE tool_name END AS tool FROM u WHERE provider = 'codex')
            SELECT CASE WHEN ordinal % 5 <> 0 THEN 'c' || (ordinal // 2) ELSE session_id || '-' || ordinal END AS key, arg_min(tool, (session_id, ordinal)) AS tool_name, min(t) AS at_us FROM e GROUP BY 1)
          SELECT tool_name, count(*) AS calls FROM (SELECT tool_name, at_us FROM a UNION ALL SELECT tool_name, at_us FROM b) WHERE {at("at_us")} BETWEEN {days} GROUP BY tool_name""",
        "stream_turn_length": f"""WITH c AS ({worked["log_rollout_turns"]}), g AS (WITH {USAGE_SQL} SELECT epoch_us("at") // 1000000 * 1000000 AS at_us, duration_ms FROM u WHERE provider = 'opencode' AND user_id % 2 = 0 AND duration_ms > 0),
          t AS (SELECT 'codex' AS provider, at_us, duration_ms AS ms FROM c UNION ALL SELECT 'grok', at_us, duration_ms FROM g)
          SELECT provider, count(*) AS turns, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.95) AS p95, max(ms) AS longest FROM t WHERE {at("at_us")} BETWEEN {days} AND ms > 0 GROUP BY provider""",
        "stream_daily_sessions": f"""WITH {USAGE_SQL}, s AS (SELECT session_id, d FROM u UNION ALL SELECT session_id, ("at" + INTERVAL 1 SECOND)::date FROM u WHERE provider = 'claude')
          SELECT d::varchar AS d, count(DISTINCT session_id) AS sessions FROM s WHERE d BETWEEN {days} GROUP BY d""",
        "stream_modes": f"""WITH {USAGE_SQL}, c AS (SELECT * FROM w WHERE provider = 'claude'), late AS (SELECT k FROM u WHERE provider = 'claude' AND ("at" + INTERVAL 1 SECOND)::date BETWEEN {days}), r AS (SELECT * FROM w WHERE provider = 'codex'),
          x AS (SELECT 'mode' AS kind, 'turns' AS label, count(*) AS n FROM c UNION ALL SELECT 'mode', 'thinking', count(*) FILTER (WHERE k % 2 = 0) FROM c UNION ALL SELECT 'mode', 'fast', count(*) FILTER (WHERE k % 3 = 0) FROM c
            UNION ALL SELECT 'effort', 'high', count(*) FROM late WHERE k % 5 = 0 UNION ALL SELECT 'effort', 'low', count(*) FROM r UNION ALL SELECT 'permission', 'never', count(*) FROM r)
          SELECT * FROM x WHERE n > 0 OR kind = 'mode'""",
        "stream_limits": f"""WITH {USAGE_SQL}, s AS (SELECT d, max(least(k + 20, 100))::double AS used FROM w WHERE provider = 'codex' GROUP BY d)
          SELECT cal.d::varchar AS d, used, CASE WHEN used IS NOT NULL THEN 'measured' ELSE 'no_use' END AS state FROM cal LEFT JOIN s USING (d)""",
        "stream_paces": f"""WITH p AS ({logged["log_dialogue_paces"]}) SELECT count(*) AS gaps, quantile_disc(gap_ms, 0.5) AS p50, quantile_disc(gap_ms, 0.9) AS p90, (sum(gap_ms) // count(*))::bigint AS mean FROM p WHERE {at("at_us")} BETWEEN DATE '{LATER.start}' AND DATE '{LATER.end}'""",
    }
