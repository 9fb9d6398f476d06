"""Queries over rollouts at work: turns with timed items, pauses, shell calls, aborts and replays.

Events of the second provider are written as the lines of their sessions' rollouts, with
overlapping and repeated items, stale completions and calls through a shell, then decoded.
:func:`oracle_sql` states the same results from the tables, by comparing lines with lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import dedupe
from meterlake.plans.adapter import USAGE_SQL, usage_events
from meterlake.plans.ingest import stored
from meterlake.plans.logs import HOME, _at, _lines, _named, _text
from meterlake.sources import codex, text

# Arguments of shell calls and the command that each runs (null: the wrapper's own name stays).
CALLS = (
    ('{"command":["bash","-lc","grep -rn foo src"]}', "grep"), ('{"command":["cargo","build"]}', "cargo"), ("not json", None), ('{"command":["/usr/bin/cat","README.md"]}', "cat"),
    ('{"command":["env","FOO=1","\'make\'","x"]}', "make"), ('{"command":["bash","--norc","-c","\\"ls\\" y"]}', "ls"), ('{"cmd":"sudo time nice rg -n x"}', "rg"), ('{"command":"(cd x && y)"}', None), ('{"command":["sh"]}', "sh"),
)


def work_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usage_events(spark, sf_dir).where("provider = 'codex'")
    i, k = F.col("ordinal"), F.col("k")
    path = _text("/logs/sessions/", F.col("session_id"), ".jsonl")
    begun = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 1000)

    def after(seconds: int | Column) -> Column:
        return _at(F.timestamp_add("SECOND", F.lit(seconds) if isinstance(seconds, int) else seconds, F.col("at")))

    def message(n: int, at: Column, which: str, **payload) -> DataFrame:
        return e.where(which).select(*_lines(path, i * 10 + n, _named(timestamp=at, type="event_msg", payload=_named(**payload))))

    def item(n: int, which: str, start: int, took: Column, name: Column | None, kind: str) -> DataFrame:
        own = {"type": kind} if name is None else {"id": name, "type": kind}
        return message(n, after(9 + n), which, type="item_completed", started_at_ms=begun + start, completed_at_ms=begun + start + took, item=_named(**own))

    head = e.groupBy("session_id", "project").agg(F.min("at").alias("at"))
    meta = head.select(*_lines(path, F.lit(-1), _named(timestamp=_at(F.timestamp_add("DAY", F.lit(-9), F.col("at"))), type="session_meta", payload=_named(id=F.col("session_id"), cwd=_text(HOME + "/", F.col("project"))))))
    arguments = F.get(F.array(*[F.lit(a) for a, _ in CALLS]), (i % len(CALLS)).cast("int"))
    call = _named(type="function_call", name=F.when(k % 2 == 0, "exec_command").otherwise(F.col("tool_name")), call_id=F.when(i % 5 != 0, _text("c", F.floor(i / 2))), arguments=arguments)
    parts = [
        message(0, after(0), "ordinal % 3 <> 0", type="task_started"),
        item(1, "k % 4 <> 3", 1000, (k % 7) * 1000, _text("x", i), "CommandExecution"),
        item(2, "k % 4 <> 3", 3000, (k % 5) * 1500, F.when(i % 4 == 0, _text("x", i)).otherwise(_text("y", i)), "McpToolCall"),
        item(3, "k % 4 <> 3", 9000, k * 10, None, "Reasoning"),
        item(4, "ordinal % 6 = 0", 500, k * 100, _text("y", i - 6), "WebSearch"),
        message(5, after(15), "ordinal % 11 = 0", type="turn_aborted", reason=F.when(k % 2 == 0, "interrupted").otherwise("replaced"), turn_id=_text("t", F.floor(i / 22))),
        message(6, after(20), "true", type="task_complete", duration_ms=F.when(i % 13 != 0, F.col("duration_ms"))),
        message(7, after(20 + (k % 40) * 60), "true", type="user_message", message="next"),
        e.select(*_lines(path, i * 10 + 8, _named(timestamp=after(21), type="response_item", payload=call))),
        message(9, after(-86400), "ordinal % 9 = 0", type="task_complete", duration_ms=F.lit(7)),
    ]
    for part in parts:
        meta = meta.union(part)
    return meta


def _decoded(spark, sf_dir) -> DataFrame:
    return codex.rows(text.parse(stored(work_lines(spark, sf_dir))), HOME)


def _told(spark, sf_dir) -> DataFrame:
    return stored(codex.told(text.parse(stored(work_lines(spark, sf_dir))), HOME))


def log_rollout_turns(spark, sf_dir):
    """Completed turns and their model time: the length less the union of tool items."""
    return codex.turns(_told(spark, sf_dir)).select("session_id", F.unix_micros("at").alias("at_us"), "duration_ms", "model_ms")


def log_rollout_paces(spark, sf_dir):
    """Pauses from a completion to the next prompt."""
    return codex.paces(_told(spark, sf_dir)).select("session_id", F.unix_micros("at").alias("at_us"), "gap_ms")


def log_rollout_tools(spark, sf_dir):
    """Tool calls by the command that they run; of a repeated call the first, at its earliest time."""
    calls = codex.tool_events(_decoded(spark, sf_dir))
    first = dedupe.keep_first(calls, ["dedupe_key"], ["path", "pos"], "at", ["session_id", "tool_name"])
    return first.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), F.min(F.unix_micros("at")).alias("first_us"), F.max(F.unix_micros("at")).alias("last_us"))


def log_rollout_interrupts(spark, sf_dir):
    cut = codex.interrupts(_decoded(spark, sf_dir))
    return dedupe.keep_first(cut, ["dedupe_key"], ["path", "pos"], "at", ["path"]).select("dedupe_key", F.unix_micros("at").alias("at_us"))


def log_rollout_touches(spark, sf_dir):
    """First and last touch of each session, and how many."""
    seen = codex.touches(_decoded(spark, sf_dir)).groupBy("session_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("touches"))
    return seen.select("session_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "touches")


WORK = f"""
e AS (SELECT *, epoch_us("at") AS t, epoch_us("at") // 1000 AS b FROM u WHERE provider = 'codex'),
item AS (
  SELECT session_id AS s, ordinal * 10 + 1 AS n, t + 10000000 AS at_us, b + 1000 AS a, b + 1000 + (k % 7) * 1000 AS z, 'x' || ordinal AS id, true AS tool FROM e WHERE k % 4 <> 3
  UNION ALL SELECT session_id, ordinal * 10 + 2, t + 11000000, b + 3000, b + 3000 + (k % 5) * 1500, CASE WHEN ordinal % 4 = 0 THEN 'x' ELSE 'y' END || ordinal, true FROM e WHERE k % 4 <> 3
  UNION ALL SELECT session_id, ordinal * 10 + 3, t + 12000000, b + 9000, b + 9000 + k * 10, NULL, false FROM e WHERE k % 4 <> 3
  UNION ALL SELECT session_id, ordinal * 10 + 4, t + 13000000, b + 500, b + 500 + k * 100, 'y' || (ordinal - 6), true FROM e WHERE ordinal % 6 = 0
), mark AS (
  SELECT session_id AS s, ordinal * 10 AS n, t AS at_us, false AS done, NULL::bigint AS ms FROM e WHERE ordinal % 3 <> 0
  UNION ALL SELECT session_id, ordinal * 10 + 5, t + 15000000, false, NULL FROM e WHERE ordinal % 11 = 0
  UNION ALL SELECT session_id, ordinal * 10 + 6, t + 20000000, true, CASE WHEN ordinal % 13 <> 0 THEN duration_ms END FROM e
  UNION ALL SELECT session_id, ordinal * 10 + 9, t - 86400000000, true, 7 FROM e WHERE ordinal % 9 = 0
), live AS (SELECT * FROM mark m WHERE NOT EXISTS (SELECT 1 FROM mark o WHERE o.s = m.s AND o.n < m.n AND o.at_us >= m.at_us)),
counted AS (SELECT * FROM item i WHERE NOT EXISTS (SELECT 1 FROM mark o WHERE o.s = i.s AND o.n < i.n AND o.at_us > i.at_us)),
fresh AS (SELECT * FROM counted i WHERE NOT EXISTS (SELECT 1 FROM counted o WHERE o.s = i.s AND o.id = i.id AND o.n < i.n)),
"""


def oracle_sql() -> dict[str, str]:
    names = " ".join(f"WHEN {n} THEN " + (f"'{name}'" if name else "'exec_command'") for n, (_, name) in enumerate(CALLS))
    prompts = f'{USAGE_SQL}, e AS (SELECT *, epoch_us("at") AS t FROM u WHERE provider = \'codex\'), p AS (SELECT session_id AS s, ordinal * 10 + 7 AS n, t + 20000000 + (k % 40) * 60000000 AS at_us FROM e)'
    completed = "c AS (SELECT session_id AS s, ordinal * 10 + 6 AS n, t + 20000000 AS at_us FROM e UNION ALL SELECT session_id, ordinal * 10 + 9, t - 86400000000 FROM e WHERE ordinal % 9 = 0)"
    lines = [f"ordinal % 3 <> 0, {0}", *["k % 4 <> 3, 10", "k % 4 <> 3, 11", "k % 4 <> 3, 12"], "ordinal % 6 = 0, 13", "ordinal % 11 = 0, 15", "true, 20", "true, 20 + (k % 40) * 60", "true, 21", "ordinal % 9 = 0, -86400"]
    touched = " UNION ALL ".join(f"SELECT session_id, t + ({x.split(', ', 1)[1]}) * 1000000::bigint AS x FROM e WHERE {x.split(', ', 1)[0]}" for x in lines)
    return {
        "log_rollout_turns": f"""WITH {USAGE_SQL}, {WORK}
          d AS (SELECT *, (SELECT max(n) FROM live o WHERE o.s = l.s AND o.n < l.n) AS since FROM live l WHERE done AND ms IS NOT NULL),
          own AS (SELECT d.s, d.n, i.a, i.z, i.tool AND i.z > i.a AS busy FROM d JOIN fresh i ON i.s = d.s AND i.n < d.n AND i.n > coalesce(d.since, -1)),
          edge AS (SELECT s, n, x, lead(x) OVER (PARTITION BY s, n ORDER BY x) AS y FROM (SELECT s, n, a AS x FROM own WHERE busy UNION SELECT s, n, z FROM own WHERE busy)),
          tooled AS (SELECT s, n, sum(y - x)::bigint AS ms FROM edge WHERE y IS NOT NULL AND EXISTS (SELECT 1 FROM own o WHERE o.s = edge.s AND o.n = edge.n AND busy AND o.a <= x AND o.z >= y) GROUP BY s, n)
          SELECT d.s AS session_id, d.at_us, d.ms AS duration_ms, CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.s = d.s AND o.n = d.n) THEN greatest(d.ms - coalesce(tooled.ms, 0), 0) END AS model_ms FROM d LEFT JOIN tooled USING (s, n)""",
        "log_rollout_paces": f"""WITH {prompts}, {completed},
          q AS (SELECT p.*, (SELECT max(c.at_us) FROM c WHERE c.s = p.s AND c.n < p.n) AS since FROM p),
          g AS (SELECT *, at_us - since AS gap FROM q WHERE at_us > since AND at_us - since <= 1800000000)
          SELECT s AS session_id, at_us, gap // 1000 AS gap_ms FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.s = g.s AND o.since = g.since AND o.n < g.n)""",
        "log_rollout_tools": f"""WITH {USAGE_SQL}, e AS (SELECT *, epoch_us("at") + 21000000 AS t, CASE WHEN k % 2 = 0 THEN CASE ordinal % {len(CALLS)} {names} END ELSE tool_name END AS tool FROM u WHERE provider = 'codex'),
          c AS (SELECT CASE WHEN ordinal % 5 <> 0 THEN 'c' || (ordinal // 2) ELSE session_id || '-' || ordinal END AS key, arg_min(session_id, (session_id, ordinal)) AS session_id, arg_min(tool, (session_id, ordinal)) AS tool_name, min(t) AS t FROM e GROUP BY 1)
          SELECT session_id, tool_name, count(*) AS calls, min(t) AS first_us, max(t) AS last_us FROM c GROUP BY session_id, tool_name""",
        "log_rollout_interrupts": f"""WITH {USAGE_SQL} SELECT 'codex-interrupt:v2:' || session_id || ':t' || (ordinal // 22) AS dedupe_key, min(epoch_us("at")) + 15000000 AS at_us FROM u WHERE provider = 'codex' AND ordinal % 11 = 0 AND k % 2 = 0 GROUP BY 1""",
        "log_rollout_touches": f"""WITH {USAGE_SQL}, e AS (SELECT *, epoch_us("at") AS t FROM u WHERE provider = 'codex'), x AS ({touched} UNION ALL SELECT session_id, min(t) - 9 * 86400000000 FROM e GROUP BY session_id)
          SELECT session_id, min(x) AS first_us, max(x) AS last_us, count(*) AS touches FROM x GROUP BY session_id""",
    }
