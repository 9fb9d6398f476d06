"""DuckDB twins of the report queries."""

from __future__ import annotations

from meterlake.operators.context import BANDS
from meterlake.operators.pricing import RATES
from meterlake.plans.adapter import USAGE_SQL
from meterlake.plans.reports import LAST_STEP, bands


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x)


PRICES = (
    "prices(price_model, r_in, r_out, r_read, r_5m, r_1h, tier, t_in, t_out, t_read, t_5m, t_1h) AS (VALUES "
    + ", ".join("(" + ", ".join(_value(x) for x in row) + ")" for row in RATES)
    + ")"
)
RESOLVE = r"""
normal AS (SELECT DISTINCT model, regexp_replace(trim(split_part(split_part(lower(model), '[', 1), '(', 1)), '\s+', '-', 'g') AS n FROM names),
named AS (SELECT model, CASE WHEN n IN ('codex', 'openai', 'codex-auto-review') THEN 'gpt-6.1-sol' ELSE n END AS name FROM normal),
met AS (
  SELECT model, p.*, length(price_model) + CASE WHEN name = price_model OR (starts_with(name, price_model) AND regexp_matches(substr(name, length(price_model) + 1), '^-(latest|[0-9])')) THEN 1000 ELSE 0 END AS score
  FROM named JOIN prices p ON name = price_model OR (starts_with(name, price_model) AND regexp_matches(substr(name, length(price_model) + 1), '^-(latest|[0-9])'))
    OR replace(name, '.', '-') = price_model
    OR (starts_with(replace(name, '.', '-'), price_model) AND regexp_matches(substr(replace(name, '.', '-'), length(price_model) + 1), '^-(latest|[0-9])'))
), rates AS (SELECT * EXCLUDE (score) FROM met QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC) = 1)
"""
COST = f"""
{PRICES}, names AS (SELECT model FROM w), {RESOLVE}, j AS (
  SELECT w.*, rates.* EXCLUDE (model), granularity = 'call' AND tier IS NOT NULL AND input + cache_read + cache_creation > tier AS above FROM w LEFT JOIN rates USING (model)
), p AS (
  SELECT *, CASE WHEN above THEN
      (input * t_in + output * t_out + cache_read * t_read + CASE WHEN w5m + w1h > 0 AND w5m + w1h <= cache_creation THEN (cache_creation - w1h) * t_5m + w1h * t_1h ELSE cache_creation * t_5m END) / 1e6
    ELSE (input * r_in + output * r_out + cache_read * r_read + CASE WHEN w5m + w1h > 0 AND w5m + w1h <= cache_creation THEN (cache_creation - w1h) * r_5m + w1h * r_1h ELSE cache_creation * r_5m END) / 1e6 END AS usd
  FROM j
)
"""
TALLY = """
CASE WHEN count(*) FILTER (WHERE usd IS NOT NULL AND volume > 0) > 0 OR coalesce(sum(volume) FILTER (WHERE usd IS NULL), 0) = 0 THEN round(coalesce(sum(usd), 0), 6) END AS usd,
coalesce(sum(volume) FILTER (WHERE usd IS NULL), 0)::bigint AS unpriced_volume
"""
SUMS = "sum(input)::bigint AS input, sum(output)::bigint AS output, sum(cache_read)::bigint AS cache_read, sum(cache_creation)::bigint AS cache_creation"
CLASSIFIED = """
m AS (SELECT *, input + cache_creation + cache_read AS context, input + cache_creation AS uncached FROM u WHERE source_kind = 'main' AND granularity = 'call' AND input + cache_creation + cache_read > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY provider, session_id ORDER BY [at], ordinal) AS n,
  date_diff('microsecond', lag([at]) OVER (PARTITION BY provider, session_id, model ORDER BY [at], ordinal), [at]) AS gap,
  CASE provider WHEN 'claude' THEN 60 WHEN 'codex' THEN 30 ELSE CASE WHEN contains(lower(model), 'claude') THEN 60 WHEN regexp_matches(lower(model), '^(gpt|codex|o1|o3|o4)') THEN 30 END END AS keep FROM m),
c AS (SELECT *, CASE WHEN session_id IS NULL THEN 'uncached' WHEN n = 1 THEN 'cold_start' WHEN uncached * 2 >= context AND gap >= keep * 60000000::bigint THEN 'expired' ELSE 'uncached' END AS reason,
  CASE WHEN context < 100000 THEN '<100K' WHEN context < 200000 THEN '100-200K' WHEN context < 500000 THEN '200-500K' ELSE '500K+' END AS band FROM g WHERE true),
cw AS (SELECT * FROM c WHERE d BETWEEN DATE '2024-01-17' AND DATE '2024-01-30')
"""
WEIGHED = f"""{PRICES}, names AS (SELECT model FROM u), {RESOLVE}, a AS (
  SELECT provider, model, context, cache_read, input, cache_creation, w5m, w1h, band, reason FROM cw
  UNION ALL SELECT provider, model, input + cache_creation + cache_read, cache_read, input, cache_creation, w5m, w1h, NULL, 'rest' FROM w WHERE NOT (source_kind = 'main' AND granularity = 'call') AND input + cache_creation + cache_read > 0
), x AS (
  SELECT a.*, w5m + w1h > 0 AND w5m + w1h <= cache_creation AS split,
    CASE WHEN r_in > 0 AND r_read / r_in BETWEEN 0 AND 10 THEN r_read / r_in ELSE 0.1::double END AS m_read,
    CASE WHEN r_in > 0 AND r_5m / r_in BETWEEN 0 AND 10 THEN r_5m / r_in ELSE 1.25::double END AS m_5m,
    CASE WHEN r_in > 0 AND r_1h / r_in BETWEEN 0 AND 10 THEN r_1h / r_in ELSE 2.0::double END AS m_1h
  FROM a LEFT JOIN rates USING (model)
), r AS (
  SELECT *, input + round(CASE WHEN split THEN cache_creation - w1h ELSE cache_creation END * m_5m)::bigint + round(CASE WHEN split THEN w1h ELSE 0 END * m_1h)::bigint AS new, round(cache_read * m_read)::bigint AS old FROM x
)"""
LENGTHS = "t AS (SELECT *, greatest(duration_ms - wait_ms, 0) AS active_ms FROM u WHERE (d IS NULL OR d BETWEEN DATE '2024-01-17' AND DATE '2024-01-30') AND greatest(duration_ms - wait_ms, 0) > 0)"
SPANS = "spans AS (SELECT session_id, d, min([at]) AS first_at, max([at]) AS last_at FROM w GROUP BY session_id, d)"
SWEPT = f"""
{SPANS}, marks AS (SELECT d, first_at AS t, 1 AS delta FROM spans WHERE first_at < last_at UNION ALL SELECT d, last_at, -1 FROM spans WHERE first_at < last_at),
swept AS (SELECT sum(delta) OVER l AS open, date_diff('microsecond', t, lead(t) OVER (PARTITION BY d ORDER BY t, delta)) // 1000000 AS seconds FROM marks
  WINDOW l AS (PARTITION BY d ORDER BY t, delta ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (SELECT *, CASE WHEN open <= 3 THEN open - 1 WHEN open <= 6 THEN 3 WHEN open <= 9 THEN 4 ELSE 5 END::int AS level FROM swept)
"""
FIRST_LINE = "l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
LINE = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
ACTIVE = """
count(*) AS turns, sum(greatest(duration_ms - wait_ms, 0))::bigint AS active_ms, sum(wait_ms)::bigint AS wait_ms,
sum(least(model_ms, greatest(duration_ms - wait_ms, 0))) FILTER (WHERE model_ms IS NOT NULL)::bigint AS model_ms,
sum(greatest(duration_ms - wait_ms, 0)) FILTER (WHERE model_ms IS NOT NULL)::bigint AS measured_ms
"""
ACTIVE_TIME = f"a AS (SELECT provider, {ACTIVE}, sum(volume)::bigint AS volume FROM w WHERE duration_ms > 0 GROUP BY provider)"


def _ladder() -> str:
    rows = []
    for rank, least, top, steps in bands():
        rows.append(f"('{rank}', {least!r}::double, {top!r}::double, {list(steps)!r}, {LAST_STEP if rank == 'SS' else 1e30!r}::double)")
    return "ladder(rank, least, top, steps, last_step) AS (VALUES " + ", ".join(rows) + ")"


RANKED = f"""{_ladder()}, sums AS (
  SELECT provider, sum(volume)::bigint AS volume, count(DISTINCT d) AS days, sum(volume)::bigint / 14.0::double AS per_day FROM w WHERE volume > 0 GROUP BY GROUPING SETS ((provider), ())
), best AS (SELECT * FROM sums LEFT JOIN ladder ON per_day >= least QUALIFY row_number() OVER (PARTITION BY provider ORDER BY least DESC) = 1)
SELECT provider, volume, days, CASE WHEN days >= 3 THEN coalesce(rank, 'unranked') ELSE 'unranked' END AS rank,
  CASE WHEN days < 3 OR rank IS NULL THEN 'Ant' WHEN per_day >= last_step THEN steps[len(steps)]
    ELSE steps[least(floor(ln(per_day / least) / ln(top / least) * len(steps))::int, len(steps) - 1) + 1] END AS name FROM best
"""


def disc(p: int) -> str:
    return f"quantile_disc(v, {p / 100})"


#: name: the query after the common views u, w and cal
BODIES = {
    "total_usage": f"SELECT {SUMS}, sum(w5m)::bigint AS w5m, sum(w1h)::bigint AS w1h, sum(volume)::bigint AS volume FROM w",
    "daily_usage": "SELECT cal.d, coalesce(sum(input), 0)::bigint AS input, coalesce(sum(output), 0)::bigint AS output, coalesce(sum(cache_read), 0)::bigint AS cache_read, coalesce(sum(cache_creation), 0)::bigint AS cache_creation, coalesce(sum(volume), 0)::bigint AS volume FROM cal LEFT JOIN w USING (d) GROUP BY cal.d",
    "hourly_profile": "SELECT hh.h::int AS h, coalesce(sum(volume), 0)::bigint AS volume FROM (SELECT unnest(range(24))::int AS h) hh LEFT JOIN w USING (h) GROUP BY hh.h",
    "provider_hours": "SELECT provider, h, sum(volume)::bigint AS volume, count(*) AS events FROM w GROUP BY provider, h",
    "distinct_sessions": "SELECT count(DISTINCT session_id) AS sessions FROM w",
    "active_days": "SELECT provider, count(DISTINCT d) AS active_days FROM w GROUP BY provider",
    "daily_sessions": "SELECT d, count(DISTINCT session_id) AS sessions FROM w GROUP BY d",
    "model_stats": ("cost", f"SELECT model, count(*) AS events, sum(volume)::bigint AS volume, {TALLY} FROM p GROUP BY model"),
    "model_daily": ("cost", f"SELECT d, model, sum(volume)::bigint AS volume, {TALLY} FROM p GROUP BY d, model"),
    "cost_by_model": ("cost", f"SELECT model, granularity, {SUMS}, {TALLY} FROM p GROUP BY model, granularity"),
    "cost_trailing": ("cost", "SELECT round(sum(usd) FILTER (WHERE d > DATE '2024-01-29'), 6) AS usd_1d, round(sum(usd) FILTER (WHERE d > DATE '2024-01-23'), 6) AS usd_7d, NULL::double AS usd_30d, round(sum(usd), 6) AS usd_period FROM p"),
    "tier_pricing": ("cost", "SELECT model, above, count(*) AS calls, round(sum(usd), 6) AS usd FROM p WHERE tier IS NOT NULL GROUP BY model, above"),
    "price_prefix_join": (
        "plain",
        f", {PRICES}, names AS (SELECT model FROM u UNION SELECT unnest(['Claude-Opus-4-8[1m]', 'gpt-5-5', 'GPT-6.1-Sol (preview)', 'claude-opus-4-8', 'claude-opus-4-8-latest', 'claude-opus-4-8-2026', 'claude-opus-4-8x', 'claude-opus-4-8-beta', 'gpt-6-1-sol', 'codex', 'gemini-3-5-flash-001', 'claude-sonnet-4-5-20250929'])), {RESOLVE} SELECT n.model, price_model, r_in, r_out FROM (SELECT DISTINCT model FROM names) n LEFT JOIN rates USING (model)",
    ),
    "project_stats": "SELECT project, sum(volume)::bigint AS volume, count(*) AS events, replace(project, 'work/', '') AS label FROM w GROUP BY project",
    "subagent_stats": "SELECT coalesce(a.name, b.name) AS name, coalesce(volume, 0)::bigint AS volume, coalesce(calls, 0)::bigint AS calls FROM (SELECT coalesce(agent, 'subagent') AS name, sum(volume) AS volume FROM w WHERE source_kind = 'subagent' OR agent IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT coalesce(agent, 'subagent') AS name, count(*) AS calls FROM w WHERE tool_name = 'Agent' GROUP BY 1) b ON a.name = b.name",
    "tool_stats": "SELECT tool_name, count(*) AS calls FROM w GROUP BY tool_name",
    "skill_stats": "SELECT skill, sum(volume)::bigint AS volume, sum(input)::bigint AS input, sum(output)::bigint AS output FROM w WHERE skill IS NOT NULL AND volume > 0 GROUP BY skill",
    "recent_window": "SELECT sum(volume)::bigint AS volume, count(DISTINCT d) AS active_days FROM w WHERE volume > 0",
    "previous_window_delta": "SELECT provider, volume, previous, CASE WHEN previous > 0 THEN round((volume - previous) * 100.0::double / previous, 0) END AS delta_percent FROM (SELECT provider, coalesce(sum(volume) FILTER (WHERE d BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'), 0)::bigint AS volume, coalesce(sum(volume) FILTER (WHERE d >= DATE '2024-01-03' AND d < DATE '2024-01-17'), 0)::bigint AS previous FROM u GROUP BY provider)",
    "modes_efforts": "SELECT 'effort-' || (k % 4) AS effort, count(*) AS turns, count(*) FILTER (WHERE k % 2 = 0) AS thinking, count(*) FILTER (WHERE k % 10 = 0) AS fast FROM w GROUP BY 1",
    "modes_summary": "SELECT kind, label, count(*) AS n FROM (SELECT 'effort' AS kind, 'effort-' || (k % 4) AS label FROM w UNION ALL SELECT 'permission', CASE k % 3 WHEN 0 THEN 'plan' ELSE 'ask' END FROM w WHERE k % 3 <> 2) GROUP BY kind, label UNION ALL SELECT 'mode', 'turns', count(*) FROM w UNION ALL SELECT 'mode', 'thinking', count(*) FROM w WHERE k % 2 = 0 UNION ALL SELECT 'mode', 'fast', count(*) FROM w WHERE k % 10 = 0",
    "interrupts": "SELECT provider, count(*) AS interrupts FROM w WHERE ordinal % 50 = 0 GROUP BY provider",
    "active_time": ("plain", f", {ACTIVE_TIME} SELECT *, CASE WHEN active_ms >= 60000 THEN (volume::hugeint * 60000 // active_ms)::bigint END AS tokens_per_minute FROM a"),
    "active_time_merged": ("plain", f", {ACTIVE_TIME} SELECT sum(turns)::bigint AS turns, sum(active_ms)::bigint AS active_ms, sum(wait_ms)::bigint AS wait_ms, sum(model_ms)::bigint AS model_ms, sum(measured_ms)::bigint AS measured_ms FROM a"),
    "peak_active_day": "SELECT provider, d, v AS active_ms FROM (SELECT provider, d, sum(greatest(duration_ms - wait_ms, 0))::bigint AS v FROM w WHERE duration_ms > 0 GROUP BY provider, d) QUALIFY row_number() OVER (PARTITION BY provider ORDER BY v DESC, d DESC) = 1",
    "credits_history": "SELECT d, round(credits, 6) AS credits, row_number() OVER (ORDER BY credits DESC, d) = 1 AS is_peak FROM (SELECT cal.d, coalesce(sum(k * 1000000) / 1e9, 0) AS credits FROM cal LEFT JOIN (SELECT * FROM w WHERE provider = 'opencode') o USING (d) GROUP BY cal.d)",
    "limits_history": "SELECT cal.d, used, CASE WHEN used IS NOT NULL THEN 'measured' WHEN active THEN 'no_sample' ELSE 'no_use' END AS state FROM cal LEFT JOIN (SELECT d, max(k)::double AS used FROM w WHERE provider = 'codex' AND k % 9 = 0 AND day(d) % 3 <> 0 GROUP BY d) s USING (d) LEFT JOIN (SELECT DISTINCT d, true AS active FROM w WHERE provider = 'codex' AND volume > 0 AND day(d) % 7 <> 0) a USING (d)",
    "turn_length": ("plain", f", {LENGTHS} SELECT provider, count(*) AS turns, quantile_disc(active_ms, 0.5) AS p50, quantile_disc(active_ms, 0.9) AS p90, quantile_disc(active_ms, 0.95) AS p95, max(active_ms) AS longest FROM t GROUP BY provider"),
    "turn_buckets": ("plain", f", {LENGTHS} SELECT CASE WHEN active_ms < 60000 THEN 0 WHEN active_ms < 300000 THEN 1 WHEN active_ms < 900000 THEN 2 WHEN active_ms < 1800000 THEN 3 WHEN active_ms < 3600000 THEN 4 ELSE 5 END::int AS bucket, count(*) AS turns FROM t GROUP BY 1"),
    "pace_stats": "SELECT count(*) AS gaps, quantile_disc(g, 0.5) AS p50, quantile_disc(g, 0.9) AS p90, (sum(g) // count(*))::bigint AS mean FROM (SELECT d, date_diff('microsecond', lag([at]) OVER (PARTITION BY session_id ORDER BY [at], ordinal), [at]) // 1000 AS g FROM u) WHERE d BETWEEN DATE '2024-01-17' AND DATE '2024-01-30' AND g > 0 AND g <= 1800000",
    "heat_levels": "SELECT d, volume, (CASE WHEN volume = 0 THEN 0 ELSE 1 + (volume > v[(len(v) - 1) // 4 + 1])::int + (volume > v[(len(v) - 1) * 2 // 4 + 1])::int + (volume > v[(len(v) - 1) * 3 // 4 + 1])::int END)::int AS level FROM (SELECT cal.d, coalesce(sum(volume), 0)::bigint AS volume FROM cal LEFT JOIN w USING (d) GROUP BY cal.d), (SELECT list(x ORDER BY x) AS v FROM (SELECT sum(volume)::bigint AS x FROM w GROUP BY d HAVING sum(volume) > 0))",
    "context_calls": ("context", "SELECT provider, reason, count(*) AS calls, sum(uncached)::bigint AS uncached, sum(cache_read)::bigint AS cached FROM cw GROUP BY provider, reason"),
    "context_bands": ("context", f""", {WEIGHED} SELECT band, count(*) AS calls, sum(context)::bigint AS context, sum(new + old)::bigint AS effective, sum(old)::bigint AS cached_effective FROM r WHERE reason <> 'rest' GROUP BY band"""),
    "context_summary": (
        "context",
        f""", {WEIGHED}, t AS (
          SELECT provider, sum(context)::bigint AS context_tokens, sum(cache_read)::bigint AS cached_tokens, count(*) FILTER (WHERE reason <> 'rest') AS calls,
            {", ".join(f"count(*) FILTER (WHERE band = '{b}') AS band{n}_calls, coalesce(sum(old) FILTER (WHERE band = '{b}'), 0)::bigint AS band{n}_cached" for n, (b, _) in enumerate(BANDS))},
            {", ".join(f"count(*) FILTER (WHERE reason = '{x}') AS {x}_calls, coalesce(sum(new) FILTER (WHERE reason = '{x}'), 0)::bigint AS {x}_tokens" for x in ("cold_start", "expired", "uncached"))},
            coalesce(sum(new + old) FILTER (WHERE reason = 'rest'), 0)::bigint AS unclassified_tokens, sum(new + old)::bigint AS effective_tokens
          FROM r GROUP BY provider)
        SELECT * REPLACE ({", ".join(f"{c}::varchar AS {c}" for c in ("context_tokens", "cached_tokens", *[f"band{n}_cached" for n in range(4)], "cold_start_tokens", "expired_tokens", "uncached_tokens", "unclassified_tokens", "effective_tokens"))}) FROM t""",
    ),
    "context_merged": ("context", "SELECT reason, count(*) AS calls, sum(uncached)::bigint AS uncached, sum(cache_read)::bigint AS cached FROM cw GROUP BY reason"),
    "models_by_label": "SELECT CASE model WHEN 'claude-opus-4-8' THEN 'Opus 4.8' WHEN 'claude-haiku-5-5' THEN 'Haiku 5.5' WHEN 'claude-sonnet-4-5-20250929' THEN 'Sonnet 4.5' WHEN 'gpt-6.1-sol' THEN 'GPT 6.1 Sol' ELSE model END AS label, sum(volume)::bigint AS volume FROM w WHERE volume > 0 GROUP BY 1",
    "ops_band": "SELECT provider, aurora, sol, luna, CASE WHEN (list_sort([aurora, sol, luna])[3] - list_sort([aurora, sol, luna])[2]) * 100 >= (aurora + sol + luna) * 15 THEN CASE greatest(aurora, sol, luna) WHEN sol THEN 'sol' WHEN luna THEN 'luna' ELSE 'aurora' END ELSE 'eclipse' END AS ops FROM (SELECT provider, coalesce(sum(volume) FILTER (WHERE h BETWEEN 5 AND 10), 0)::bigint AS aurora, coalesce(sum(volume) FILTER (WHERE h BETWEEN 11 AND 17), 0)::bigint AS sol, coalesce(sum(volume) FILTER (WHERE h NOT BETWEEN 5 AND 17), 0)::bigint AS luna FROM w GROUP BY provider)",
    "codename_rank": ("plain", f", {RANKED}"),
    "session_day_bounds": ("plain", f", {SPANS} SELECT session_id, d, first_at, last_at FROM spans"),
    "concurrency_levels": ("plain", f", {SWEPT} SELECT level, sum(seconds)::bigint AS seconds FROM levels WHERE open > 0 AND seconds > 0 GROUP BY level"),
    "concurrency_peak": ("plain", f", {SWEPT} SELECT max(open)::bigint AS peak, round(sum(([1, 2, 3, 5, 8, 11])[level + 1] * seconds) FILTER (WHERE open > 0 AND seconds > 0) / sum(seconds) FILTER (WHERE open > 0 AND seconds > 0), 6) AS mean FROM levels"),
    "streaks": "SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE last_day = DATE '2024-01-30'), 0) AS current FROM (SELECT user_id, count(*) AS n, max(d) AS last_day FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::int AS run FROM (SELECT DISTINCT user_id, d FROM w WHERE volume > 40000)) GROUP BY user_id, run) GROUP BY user_id",
    "longest_session": ("plain", f", {SPANS} SELECT session_id, first_at, last_at, date_diff('microsecond', first_at, last_at) // 1000000 AS seconds FROM spans ORDER BY last_at - first_at DESC, first_at DESC, session_id DESC LIMIT 1"),
    "session_report": ("cost", f"SELECT session_id, min([at]) AS first_at, max([at]) AS last_at, count(*) AS events, sum(volume)::bigint AS volume, {TALLY} FROM p WHERE session_id = 's7' GROUP BY session_id"),
    "ordered_turn_lengths": ("plain", f", {LENGTHS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY [at], ordinal)::int AS n, [at], active_ms FROM t"),
    "cumulative_delta": "SELECT session_id, model, sum(CASE WHEN pi IS NULL OR input < pi OR output < po THEN input ELSE input - pi END)::bigint AS d_input, sum(CASE WHEN pi IS NULL OR input < pi OR output < po THEN output ELSE output - po END)::bigint AS d_output FROM (SELECT *, lag(input) OVER l AS pi, lag(output) OVER l AS po FROM u WINDOW l AS (PARTITION BY session_id, model ORDER BY [at], ordinal)) GROUP BY session_id, model",
    "credit_delta": "SELECT session_id, sum(CASE WHEN p IS NULL OR nano < p THEN nano ELSE nano - p END)::bigint AS d_nano FROM (SELECT session_id, nano, lag(nano) OVER (PARTITION BY session_id ORDER BY [at], ordinal) AS p FROM (SELECT *, k * 1000000 AS nano FROM u WHERE provider = 'opencode')) GROUP BY session_id",
    "carry_forward": "SELECT session_id, m AS model, count(*) AS events FROM (SELECT session_id, last_value(CASE WHEN k % 5 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY [at], ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM u) GROUP BY session_id, m",
    "interval_union": "SELECT session_id, d, sum(greatest(e - greatest(s, coalesce(upto, s)), 0))::bigint AS busy_ms FROM (SELECT session_id, d, s, e, max(e) OVER (PARTITION BY session_id, d ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (SELECT session_id, d, epoch_us([at]) // 1000 AS s, epoch_us([at]) // 1000 + duration_ms AS e FROM w)) GROUP BY session_id, d",
    "inactivity_sessions": "SELECT user_id, stretch, count(*) AS events, min([at]) AS first_at, max([at]) AS last_at FROM (SELECT user_id, [at], sum(cut) OVER (PARTITION BY user_id ORDER BY [at], ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint AS stretch FROM (SELECT *, CASE WHEN g IS NULL OR g > 1800000000 THEN 1 ELSE 0 END AS cut FROM (SELECT user_id, [at], ordinal, date_diff('microsecond', lag([at]) OVER (PARTITION BY user_id ORDER BY [at], ordinal), [at]) AS g FROM w))) GROUP BY user_id, stretch",
    "event_pairing": "SELECT user_id, pid AS start_id, event_id AS end_id, date_diff('microsecond', pat, ts) // 1000 AS took_ms FROM (SELECT *, lag(event_type) OVER l AS pt, lag(event_id) OVER l AS pid, lag(ts) OVER l AS pat FROM events WHERE event_type IN ('view', 'purchase') WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND pt = 'view'",
    "dedupe_usage": (
        "plain",
        f""", n AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS part, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS n FROM lineitem),
        r AS (SELECT *, l_quantity > coalesce(max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS rec FROM n),
        q AS (SELECT *, CASE WHEN rec THEN -n ELSE 1000000 + n END AS prec FROM r)
        SELECT l_orderkey, min(l_shipdate) AS l_shipdate, arg_min(l_quantity, prec) AS l_quantity, arg_min(l_extendedprice, prec) AS l_extendedprice, arg_min(part, prec) FILTER (WHERE part IS NOT NULL) AS part, arg_min(flag, prec) FILTER (WHERE flag IS NOT NULL) AS flag FROM q GROUP BY l_orderkey""",
    ),
    "dedupe_duration": (
        "plain",
        f""", n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS n, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
        SELECT l_orderkey, min(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity, arg_min(l_partkey, n) AS l_partkey, arg_min(l_returnflag, n) AS l_returnflag FROM n WHERE l_quantity = top GROUP BY l_orderkey""",
    ),
    "dedupe_first_earliest": ("plain", f", n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {FIRST_LINE}) AS n FROM lineitem) SELECT l_orderkey, min(l_shipdate) AS l_shipdate, arg_min(l_partkey, n) AS l_partkey FROM n GROUP BY l_orderkey"),
    "dedupe_flags": "SELECT l_orderkey, min(l_shipdate) AS l_shipdate, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY l_orderkey",
    "strongest_source": "SELECT session_id, model, k % 4 AS strength, [at], volume FROM u QUALIFY row_number() OVER (PARTITION BY session_id, model ORDER BY k % 4 DESC, ordinal) = 1",
    "record_echo": "SELECT session_id, count(*) AS calls, sum(volume)::bigint AS volume FROM u c WHERE granularity = 'call' AND NOT EXISTS (SELECT 1 FROM u r WHERE r.granularity = 'aggregate' AND r.session_id = c.session_id AND r.k = c.k AND r.model = c.model AND r.ordinal < c.ordinal) GROUP BY session_id",
    "pace_semi_join": "SELECT session_id, count(*) AS events, sum(volume)::bigint AS volume FROM u WHERE (session_id, d) IN (SELECT session_id, d FROM u WHERE tool_name = 'Agent') GROUP BY session_id",
    "supersede_anti": ("plain", ", f AS (SELECT session_id, min([at]) AS first_call FROM u WHERE ordinal % 3 = 0 GROUP BY session_id), s AS (SELECT ordinal, session_id, [at], model || ':' || k AS key, volume FROM u WHERE ordinal % 3 = 1), dead AS (SELECT key FROM s JOIN f USING (session_id) WHERE [at] >= first_call) SELECT ordinal, session_id, key, volume FROM s WHERE key NOT IN (SELECT key FROM dead)"),
    "fork_cutoff": ("plain", ", b AS (SELECT conv_id + 1 AS conv_id, min(turn) AS cutoff FROM conversations WHERE conv_id % 3 = 0 AND role = 'assistant' GROUP BY conv_id) SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations LEFT JOIN b USING (conv_id) WHERE conv_id % 3 = 1 AND (cutoff IS NULL OR turn > cutoff) GROUP BY conv_id"),
    "ancestry_depth": "SELECT c_custkey AS id, (CASE WHEN c_custkey = 0 THEN 0 ELSE floor(log2(c_custkey)) END)::int AS depth FROM customer",
    "event_export": "SELECT provider, [at], ordinal, session_id, model, volume, granularity FROM w",
    "top_models": ("plain", ", s AS (SELECT model, sum(volume)::bigint AS volume, row_number() OVER (ORDER BY sum(volume) DESC, model) AS n FROM w GROUP BY model) SELECT model, volume FROM s WHERE n <= 3 UNION ALL SELECT '+' || count(*) || ' more', sum(volume)::bigint FROM s WHERE n > 3"),
    "busiest": "SELECT (SELECT d FROM w GROUP BY d ORDER BY sum(volume) DESC, d DESC LIMIT 1) AS d, (SELECT sum(volume)::bigint FROM w GROUP BY d ORDER BY 1 DESC LIMIT 1) AS day_volume, (SELECT h FROM w GROUP BY h ORDER BY sum(volume) DESC, h DESC LIMIT 1) AS h, (SELECT sum(volume)::bigint FROM w GROUP BY h ORDER BY 1 DESC LIMIT 1) AS hour_volume",
    "provider_order": "SELECT provider, sum(volume)::bigint AS volume, count(DISTINCT session_id) AS sessions, row_number() OVER (ORDER BY sum(volume) DESC, provider)::int AS place FROM w GROUP BY provider",
    "providers_shown": "SELECT provider, string_agg(DISTINCT fact, ',' ORDER BY fact) AS facts FROM (SELECT provider, unnest(['sessions', 'tools', CASE WHEN volume > 0 THEN 'tokens' END, CASE WHEN input + cache_creation + cache_read > 0 THEN 'context' END, CASE WHEN greatest(duration_ms - wait_ms, 0) > 0 THEN 'turns' END, CASE WHEN ordinal % 50 = 0 THEN 'interrupts' END, CASE WHEN provider = 'opencode' THEN 'credits' END]) AS fact FROM w) WHERE fact IS NOT NULL GROUP BY provider",
    "weekday_profile": "SELECT (isodow(cal.d) - 1)::int AS weekday, coalesce(sum(v), 0)::bigint AS volume, count(*) FILTER (WHERE v > 0) AS active_days, count(*) AS days, (isodow(cal.d) % 7)::int AS card_column FROM cal LEFT JOIN (SELECT d, sum(volume) AS v FROM w GROUP BY d) x USING (d) GROUP BY isodow(cal.d)",
    "cached_share": "SELECT provider, round(sum(cache_read) / sum(input + cache_creation + cache_read), 6) AS share FROM w GROUP BY provider",
}


def twins() -> dict[str, str]:
    found = {}
    for name, body in BODIES.items():
        kind, text = body if isinstance(body, tuple) else ("none", body)
        middle = {"cost": f", {COST}", "context": f", {CLASSIFIED}"}.get(kind, "")
        found[name] = f"WITH {USAGE_SQL}{middle} {text}".replace("[at]", '"at"')
    return found


#: Queries with a date column d.
DATED = {"daily_usage", "daily_sessions", "model_daily", "peak_active_day", "credits_history", "limits_history", "heat_levels", "session_day_bounds", "interval_union", "busiest"}
