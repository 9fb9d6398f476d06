"""Queries over message stores: conversations written as SQLite stores of two generations, then decoded.

Of three conversations one is a legacy session, one a new session and one a fork of the one
before it. Some legacy sessions were also copied to new stores, read earlier or later; some rows
are broken. :func:`oracle_sql` states the same results from the table of conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.tables import shared_folder, stored
from meterlake.plans.adapter import read
from meterlake.plans.logs import HOME, _named, _text
from meterlake.plans.stores import write_stores
from meterlake.sources import opencode

BEGIN = 1_704_067_200_000  # 2024-01-01
SHAPES = {
    "message": "id TEXT, session_id TEXT, time_created INT, data TEXT", "part": "id TEXT, message_id TEXT, session_id TEXT, time_created INT, data TEXT", "session": "id TEXT, directory TEXT",
    "session_message": "id TEXT, session_id TEXT, type TEXT, seq INT, time_created INT, data TEXT", "session_v2": "id TEXT, directory TEXT, fork_session_id TEXT, fork_boundary TEXT",
}
CELLS = ("id", "message_id", "session_id", "type", "seq", "time_created", "data", "directory", "fork_session_id", "fork_boundary")


def _cells(df: DataFrame, store, table: str, **values) -> DataFrame:
    kinds = {c: "long" if c in ("seq", "time_created") else "string" for c in CELLS}
    return df.select((store if not isinstance(store, str) else F.lit(store)).alias("store"), F.lit(table).alias("tbl"), *[(values[c] if c in values else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, table and cells of all rows."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("t"), "role", F.coalesce("text", F.lit("")).alias("text"))
    conv, t = F.col("c"), F.col("t")
    own = _text("opencode-", conv % 4, ".db")
    name, session = _text("m", conv, "-", t), _text("c", conv)
    made = F.lit(BEGIN) + conv * 1_000_000 + t * 60_000
    tokens = _named(input=F.length("text") * 3, output=t * 7 + 1, reasoning=t % 3, cache=_named(read=conv % 5 * 1000, write=t % 2 * 100))
    time = _named(created=made, completed=F.when(t % 4 != 3, made + (t + 1) * 5000 - 7000))
    answer = F.col("role") == "assistant"
    old, new, fork = c.where("c % 3 = 0"), c.where("c % 3 = 1"), c.where("c % 3 = 2")
    body = F.to_json(_named(role=F.col("role"), modelID="claude-opus-4-8", tokens=tokens, time=time, path=_named(cwd=_text(HOME + "/w", conv % 3)), finish="stop"))
    broken = F.when((conv % 9 == 0) & (t == 1), "{").otherwise(body)
    rows = _cells(old, own, "message", id=name, session_id=session, time_created=made, data=broken)
    calls = old.where(answer).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    part = F.to_json(_named(type=F.when(F.col("n") == 2, "text").otherwise("tool"), tool=F.when(F.col("n") == 0, "read").otherwise("bash"), state=_named(time=_named(start=F.when(F.col("n") == 0, made + 5)))))
    rows = rows.union(_cells(calls, own, "part", id=_text("p", conv, "-", t, "-", F.col("n")), message_id=name, session_id=session, time_created=made + 9, data=part))
    content = F.array(_named(type="tool", name="grep", time=_named(created=made + 3)), _named(type="text", name="x", time=_named(created=made)), _named(type="tool", name="edit", time=_named(created=F.lit(None).cast("long"))))
    later = F.to_json(_named(time=time, model=_named(id="gpt-6.1-sol"), tokens=tokens, content=content, finish="end"))
    kind = F.when((t % 5 == 4) & ~answer, "compaction").otherwise(F.col("role"))
    copied = old.where("c % 6 = 0")
    moved = F.when(conv % 12 == 0, "opencode--m.db").otherwise("opencode-z.db")
    for some, store in ((new, own), (fork, own), (copied, moved)):
        rows = rows.union(_cells(some, store, "session_message", id=name, session_id=session, type=kind, seq=t, time_created=made, data=later))
    # a fork lies in the store of its parent
    rows = rows.withColumn("store", F.when((F.col("tbl") == "session_message") & (F.substring("session_id", 2, 20).cast("long") % 3 == 2), _text("opencode-", (F.substring("session_id", 2, 20).cast("long") - 1) % 4, ".db")).otherwise(F.col("store")))
    heads = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c")).distinct()
    where = F.when(conv % 2 == 0, _text(HOME + "/d", conv % 4))
    rows = rows.union(_cells(heads.where("c % 3 = 1"), own, "session_v2", id=session, directory=where)).union(_cells(heads.where("c % 3 = 1"), own, "session", id=session, directory=_text("/other/d", conv % 4)))
    boundary = F.to_json(_named(type=F.when(conv % 7 == 0, "odd").when(conv % 2 == 0, "through").otherwise("before"), messageID=_text("m", conv - 1, "-1")))
    parent = F.when(conv % 11 == 0, "gone").otherwise(_text("c", conv - 1))
    return rows.union(_cells(heads.where("c % 3 = 2"), _text("opencode-", (conv - 1) % 4, ".db"), "session_v2", id=session, fork_session_id=parent, fork_boundary=boundary))


def _tables(spark, sf_dir) -> opencode.Tables:
    paths = write_stores(store_rows(spark, sf_dir), shared_folder(spark), SHAPES)
    return opencode.Tables(*[stored(t) for t in opencode.read_tables(spark, paths)])


def _told(spark, sf_dir) -> DataFrame:
    return stored(opencode.messages(_tables(spark, sf_dir), HOME))


def store_message_usage(spark, sf_dir):
    """Answers and compactions of both generations, each message once, forks without their copies."""
    used = opencode.usage_events(_told(spark, sf_dir))
    return used.select("dedupe_key", "session_id", F.unix_micros("at").alias("at_us"), "model", "project", "input", "output", "reasoning", "cache_read", "cache_creation", "volume")


def store_message_turns(spark, sf_dir):
    return opencode.durations(_told(spark, sf_dir)).select("session_id", F.unix_micros("at").alias("at_us"), "duration_ms", "status")


def store_message_tools(spark, sf_dir):
    """Tool calls, those of one generation for each message."""
    tables = _tables(spark, sf_dir)
    calls = opencode.tool_events(tables, stored(opencode.messages(tables, HOME)))
    return calls.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), F.sum(F.unix_micros("at")).alias("sum_us"))


def store_message_touches(spark, sf_dir):
    seen = opencode.touches(_told(spark, sf_dir)).groupBy("session_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("touches"))
    return seen.select("session_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "touches")


def store_scan(spark, sf_dir):
    """Stores, rows and rows that don't parse; stores that a limit cut."""
    return opencode.scan_stats(_tables(spark, sf_dir))


STORES = f"""
m AS (SELECT conv_id AS c, turn::bigint AS t, role, coalesce(text, '') AS text, {BEGIN} + conv_id * 1000000 + turn::bigint * 60000 AS made, role = 'assistant' AS answer FROM conversations),
cut AS (
  SELECT f.c, CASE WHEN f.c % 2 = 0 THEN 1 ELSE (SELECT max(t) FROM m p WHERE p.c = f.c - 1 AND p.t < 1) END AS copied
  FROM (SELECT DISTINCT c FROM m WHERE c % 3 = 2 AND c % 7 <> 0 AND c % 11 <> 0) f WHERE EXISTS (SELECT 1 FROM m p WHERE p.c = f.c - 1 AND p.t = 1)
), g AS (
  SELECT m.*, CASE WHEN c % 3 <> 0 THEN 1 WHEN c % 12 = 0 OR (c % 9 = 0 AND t = 1) THEN 1 ELSE 0 END AS generation FROM m LEFT JOIN cut USING (c)
  WHERE (copied IS NULL OR t > copied) AND NOT (c % 3 = 0 AND c % 6 <> 0 AND c % 9 = 0 AND t = 1)
), e AS (SELECT *, answer OR (generation = 1 AND t % 5 = 4) AS used FROM g)
"""


def oracle_sql() -> dict[str, str]:
    project = "CASE WHEN c % 3 = 2 OR (c % 3 = 0 AND generation = 1) THEN NULL WHEN c % 3 = 0 THEN 'w0' WHEN c % 2 = 0 THEN 'd' || (c % 4) ELSE 'other/d' || (c % 4) END"
    return {
        "store_message_usage": f"""WITH {STORES}, x AS (SELECT *, length(text) * 3 AS input, t * 7 + 1 + t % 3 AS output, c % 5 * 1000 AS cache_read, t % 2 * 100 AS cache_creation FROM e WHERE used)
          SELECT 'opencode:m' || c || '-' || t AS dedupe_key, 'c' || c AS session_id, made * 1000 AS at_us, CASE generation WHEN 0 THEN 'claude-opus-4-8' ELSE 'gpt-6.1-sol' END AS model, {project} AS project,
            input, output, t % 3 AS reasoning, cache_read, cache_creation, input + output + cache_read + cache_creation AS volume FROM x""",
        "store_message_turns": f"WITH {STORES} SELECT 'c' || c AS session_id, made * 1000 AS at_us, greatest((t + 1) * 5000 - 7000, 0) AS duration_ms, CASE generation WHEN 0 THEN 'stop' ELSE 'end' END AS status FROM e WHERE answer AND t % 4 <> 3",
        "store_message_tools": f"""WITH {STORES}, old AS (SELECT c, made, unnest(['read', 'bash']) AS tool_name, unnest([5, 9]) AS plus FROM m WHERE c % 3 = 0 AND c % 12 <> 0 AND answer),
          new AS (SELECT c, made, unnest(['grep', 'edit']) AS tool_name, unnest([3, 0]) AS plus FROM g WHERE answer AND (c % 3 <> 0 OR c % 12 = 0))
          SELECT 'c' || c AS session_id, tool_name, count(*) AS calls, sum((made + plus) * 1000)::bigint AS sum_us FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY c, tool_name""",
        "store_message_touches": f"WITH {STORES} SELECT 'c' || c AS session_id, min(made) * 1000 AS first_us, max(made) * 1000 AS last_us, count(*) AS touches FROM g GROUP BY c",
        "store_scan": """SELECT 6::bigint AS stores, (count(*) FILTER (WHERE conv_id % 3 = 0) + 3 * count(*) FILTER (WHERE conv_id % 3 = 0 AND role = 'assistant') + count(*) FILTER (WHERE conv_id % 3 <> 0 OR conv_id % 6 = 0))::bigint AS rows,
          count(*) FILTER (WHERE conv_id % 9 = 0 AND turn = 1) AS parse_errors, 0::bigint AS cut_stores FROM conversations""",
    }
