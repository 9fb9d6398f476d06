"""Queries over forks and ledgers: sessions copied by forks, and calls against snapshots.

Update logs get summaries and two generations of copies, some without their originals; snapshot
logs get a SQLite ledger of later calls, with unreadable rows in some sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.tables import shared_folder, stored
from meterlake.operators import ancestry, dedupe
from meterlake.plans.adapter import USAGE_SQL, read, usage_events
from meterlake.plans.ingest import COUNTERS, METADATA
from meterlake.plans.log_twins import SNAPS
from meterlake.plans.logs import HOME, _at, _named, _shown, _text, snapshot_lines, update_lines
from meterlake.plans.stores import write_stores
from meterlake.sources import copilot, grok, text, updates


def fork_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent for four of five customers, somewhere in the table: chains, trees and cycles; some parents are missing."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    n = F.col("node")
    return c.select("node", F.when(n % 5 != 0, F.when(n % 97 == 0, n + 100_000_000).when(n % 31 == 0, n + 62).otherwise(F.floor(n * 5 / 6).cast("long"))).alias("parent"))


def fork_depths(spark, sf_dir):
    """Ancestors of each node by pointer jumping, 64 at most."""
    return ancestry.depths(fork_parents(spark, sf_dir))


def _forked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of sessions and their forks, and summaries; every other original is gone."""
    own = update_lines(spark, sf_dir)
    user = F.regexp_extract("path", r"/s(\d+)/", 1).cast("long")
    copy = lambda folder, days, body: F.struct(F.concat(F.lit(f"/logs/{folder}/{folder}"), F.col("user").cast("string"), F.lit("/updates.jsonl")).alias("path"), F.regexp_replace(body, r'"timestamp":(\d)', f'"timestamp":{days}$1').alias("line"))
    line = F.col("line")
    first = F.when(F.col("user") % 12 != 2, F.struct("path", "line"))
    # all copies of a line at once, so that the table is read and the line is written once
    every = F.array(first, copy("f", 2, line), copy("e", 3, line), copy("a", 1, F.regexp_replace("line", '"prompt_id":"p', '"prompt_id":"q')))
    lines = own.select("path", "pos", "line", user.alias("user")).select("pos", F.explode(every).alias("x")).where("x is not null").select("x.path", "pos", "x.line")
    users = stored(own.select(user.alias("u")).distinct())
    body = lambda **x: F.to_json(_named(**x))
    place = lambda folder: _text(f"/logs/{folder}/", folder if folder != "g" else "s", F.col("u"), "/summary.json").alias("path")
    told = users.select(place("g"), body(info=_named(cwd=_text(HOME + "/r", F.col("u") % 3))).alias("text"))
    told = told.union(users.select(place("f"), body(session_kind="fork", parent_session_id=_text("s", F.col("u")), info=_named(cwd=HOME)).alias("text")))
    told = told.union(users.select(place("e"), body(session_kind="worktree", parent_session_id=_text("f", F.col("u"))).alias("text")))
    return lines, told.union(users.select(place("a"), F.when(F.col("u") % 4 == 0, "{").otherwise(body(session_kind="subagent", parent_session_id=_text("s", F.col("u"))))))


def log_fork_usage(spark, sf_dir):
    """Usage of sessions and forks: each turn once, from the oldest copy that is left; no subagent's."""
    lines, summaries = _forked(spark, sf_dir)
    lines = stored(lines)
    known = stored(grok.sessions(stored(lines.select("path").distinct()), stored(summaries), HOME))
    used = stored(grok.usage_of(lines, known))
    # what these logs never tell is the same in all rows and needs no merge
    same = {"granularity": F.lit("aggregate"), "source_kind": F.lit("main"), "provider": F.lit("grok")}
    same |= {c: F.lit(0).cast("long") for c in COUNTERS if c not in used.columns} | {c: F.lit(None).cast("string") for c in METADATA if c not in used.columns}
    told = lambda names: [c for c in names if c not in same]
    merged = dedupe.merge_usage(used.drop("granularity", "source_kind"), ["dedupe_key"], "volume", ["rank", "path", "pos"], "at", told(COUNTERS), told(METADATA))
    return _shown(merged.withColumns(same))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the later half of the month for two of three sessions, some rows broken."""
    e = usage_events(spark, sf_dir).where("provider = 'opencode' and user_id % 2 = 1 and user_id % 9 <> 2")
    i, user = F.col("ordinal"), F.col("user_id")
    late = e.where(F.dayofmonth("d") > 15)
    stamp = F.when(i % 2 == 0, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).otherwise(_at(F.date_trunc("second", "at")))
    broken = F.when((user % 5 == 0) & (i % 20 == 0), "soon").otherwise(stamp)
    whole = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    store = F.lit("session-store.db")
    calls = late.select(store.alias("store"), F.lit("assistant_usage_events").alias("tbl"), *[x.alias(n) for n, x in {
        "id": i.cast("string"), "session_id": F.col("session_id"), "model": F.col("model"), "input_tokens": whole, "output_tokens": F.col("output"), "cache_read_tokens": F.col("cache_read"), "cache_write_tokens": F.col("cache_creation"),
        "reasoning_tokens": F.lit(0).cast("long"), "agent_id": F.when(i % 7 == 0, "x"), "initiator": F.when(i % 3 == 0, "sub-agent").otherwise("user"), "created_at": broken, "cwd": F.lit(None).cast("string"),
    }.items()])
    none = F.lit(None)
    heads = e.select("session_id", "project").distinct()
    kinds = dict(calls.dtypes)
    given = {"store": store, "tbl": F.lit("sessions"), "id": F.col("session_id"), "cwd": _text(HOME + "/", F.col("project")), "session_id": none}
    return calls.union(heads.select(*[given.get(c, none).cast(kinds[c]).alias(c) for c in calls.columns]))


SHAPES = {
    "assistant_usage_events": "id INT, session_id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, agent_id TEXT, initiator TEXT, created_at TEXT",
    "sessions": "id TEXT, cwd TEXT",
}


def log_ledger_usage(spark, sf_dir):
    """Snapshots up to a session's first call, then its calls; incomplete sessions by the fallback."""
    snapshots = stored(updates.copilot_usage(updates.copilot_rows(text.parse(stored(snapshot_lines(spark, sf_dir))))))
    paths = write_stores(ledger_rows(spark, sf_dir), shared_folder(spark), SHAPES)
    book = copilot.ledger(*[stored(t) for t in copilot.read_ledger(spark, paths)], HOME)
    kept, calls = copilot.reconcile(snapshots, book)
    every = kept.withColumn("project", F.lit(None).cast("string")).withColumn("source_kind", F.lit("main")).unionByName(calls, allowMissingColumns=True)
    return every.select("dedupe_key", "session_id", F.unix_micros("at").alias("at_us"), "model", "project", "source_kind", "granularity", "input", "output", "cache_read", "cache_creation", "volume")


def oracle_sql() -> dict[str, str]:
    return {
        "fork_depths": """WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 100000000 WHEN c_custkey % 31 = 0 THEN c_custkey + 62 ELSE c_custkey * 5 // 6 END END AS parent FROM customer),
          w(node, cur, depth) AS (SELECT node, parent, 0 FROM p UNION ALL SELECT w.node, p.parent, depth + 1 FROM w LEFT JOIN p ON p.node = w.cur WHERE cur IS NOT NULL AND depth < 64)
          SELECT node, max(depth)::int AS depth FROM w GROUP BY node""",
        "log_fork_usage": f"""WITH {USAGE_SQL}, g AS (SELECT *, (epoch_us("at") // 1000000)::varchar AS sec FROM u WHERE provider = 'opencode' AND user_id % 2 = 0),
          x AS (SELECT *, CASE WHEN user_id % 12 = 2 THEN 'f' ELSE 's' END || user_id AS sid, least(('2' || sec)::bigint, CASE WHEN user_id % 12 <> 2 THEN sec::bigint ELSE ('2' || sec)::bigint END, ('3' || sec)::bigint) AS first FROM g)
          SELECT 'grok' AS provider, 'grok:p' || ordinal || ':' || model AS dedupe_key, first * 1000000 AS at_us, sid AS session_id, model, CASE WHEN user_id % 12 = 2 THEN '~' ELSE 'r' || (user_id % 3) END AS project, 'main' AS source_kind, 'aggregate' AS granularity,
            NULL AS agent, NULL AS skill, input, output, cache_read, cache_creation, 0::bigint AS w5m, 0::bigint AS w1h, volume FROM x WHERE volume > 0""",
        "log_ledger_usage": f"""WITH {USAGE_SQL}, {SNAPS},
          snap AS (SELECT 'copilot:c' || ordinal || ':' || model AS dedupe_key, session_id, epoch_us("at") AS at_us, model, NULL AS project, 'main' AS source_kind, 'aggregate' AS granularity, greatest(greatest(di - dr, 0) - dc, 0) AS input, dd AS output, dr AS cache_read, dc AS cache_creation FROM s3),
          shot AS (SELECT *, input + output + cache_read + cache_creation AS volume FROM snap WHERE input + output + cache_read + cache_creation > 0),
          row AS (SELECT *, epoch_us("at") // 1000000 * 1000000 AS at_us, user_id % 5 = 0 AND ordinal % 20 = 0 AS broken FROM u WHERE provider = 'opencode' AND user_id % 2 = 1 AND user_id % 9 <> 2 AND day(d) > 15),
          torn AS (SELECT DISTINCT session_id FROM row WHERE broken), upto AS (SELECT session_id, max(at_us) AS covered FROM shot GROUP BY session_id),
          calls AS (SELECT 'copilot-call:' || ordinal AS dedupe_key, session_id, at_us, model, project, CASE WHEN ordinal % 7 = 0 OR ordinal % 3 = 0 THEN 'subagent' ELSE 'main' END AS source_kind, 'call' AS granularity, input, output, cache_read, cache_creation, volume
            FROM row LEFT JOIN upto USING (session_id) WHERE NOT broken AND volume > 0 AND (session_id NOT IN (FROM torn) OR covered IS NULL OR at_us > covered)),
          first AS (SELECT session_id, min(at_us) AS first_us FROM row WHERE NOT broken AND session_id NOT IN (SELECT session_id FROM torn JOIN upto USING (session_id)) GROUP BY session_id)
          SELECT shot.* FROM shot LEFT JOIN first USING (session_id) WHERE first_us IS NULL OR at_us < first_us UNION ALL SELECT * FROM calls""",
    }
