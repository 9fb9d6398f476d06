"""Queries over conversation stores and text logs of the last agent.

Events of the first provider are encoded as binary generations, steps and conversation heads
in one SQLite store for each session, with copies of some stores in a second root; their
prompts and tools become text logs and a history file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.tables import shared_folder, stored
from meterlake.plans.adapter import USAGE_SQL, usage_events
from meterlake.plans.logs import HOME, _named, _place, _text
from meterlake.plans.stores import write_stores
from meterlake.sources import agy


def number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(fields: list[tuple[int, int | str | bytes | list | None]]) -> bytes:
    """A message of (field, number, text, bytes or message); absent values are left out."""
    out = b""
    for field, value in fields:
        if isinstance(value, int):
            out += number(field << 3) + number(value)
        elif value is not None:
            body = encode(value) if isinstance(value, list) else value.encode() if isinstance(value, str) else value
            out += number(field << 3 | 2) + number(len(body)) + body
    return out


def stamp(ms: int | None) -> list | None:
    return None if ms is None else [(1, int(ms) // 1000), (2, int(ms) % 1000 * 1_000_000)]


def generation(r) -> bytes:
    usage = [(1, r.system), (2, r.fresh), (3, r.total), (5, r.cache_read), (9, r.output_text), (10, r.thinking), (11, r.response_id)]
    chat = [(2, 7), (4, usage), (9, [(4, stamp(r.row_ms))] if r.row_ms is not None else None), (19, r.served), (21, r.display)]
    return encode([(1, chat), (3, [(28, r.selected)] if r.selected is not None else None)])


def _encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for given in frame.itertuples(index=False):
            r = given._replace(**{n: None if x is None or x != x else int(x) if isinstance(x, float) else x for n, x in given._asdict().items()})
            if r.kind == "generation":
                blob = generation(r)
            elif r.kind == "step":
                blob = encode([(1, stamp(r.row_ms)), (9, [(11, r.response_id)])])
            else:
                blob = encode([(1, [(1, r.served)]), (2, stamp(r.row_ms))])
            rows.append((r.store, {"generation": "gen_metadata", "step": "steps", "head": "trajectory_metadata_blob"}[r.kind], f"{r.idx:012d}", r.idx, None if r.kind == "step" else blob, blob if r.kind == "step" else None))
        yield pd.DataFrame(rows, columns=["store", "tbl", "id", "idx", "data", "metadata"])


SHAPES = {"gen_metadata": "idx INT, data BLOB", "steps": "idx INT, metadata BLOB", "trajectory_metadata_blob": "id TEXT, data BLOB"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).where("provider = 'claude'").withColumn("ms", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 1000))


def _cells(spark: SparkSession, sf_dir: str, copy: bool) -> DataFrame:
    e = _events(spark, sf_dir)
    i, k, ms = F.col("ordinal"), F.col("k"), F.col("ms")
    if copy:
        e = e.where("user_id % 2 = 0")
    store = F.concat("session_id", F.lit(".db")).alias("store")
    thinking = k % 7
    total = F.when(i % 29 != 0, F.col("output") + thinking + F.when(i % 23 == 0, 1).otherwise(0))
    row_ms = F.when(i % 8 == 2, ms + 9) if copy else F.when(i % 4 == 0, ms)
    rid = F.when(i % 3 != 0, _text("r", i))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    columns = ["store", "kind", "idx", "system", "fresh", "total", "cache_read", "output_text", "thinking", "response_id", "row_ms", "served", "display", "selected"]
    made = e.select(
        store, F.lit("generation").alias("kind"), i.alias("idx"), k.alias("system"), F.col("input").alias("fresh"), total.alias("total"), F.col("cache_read"), F.col("output").alias("output_text"), thinking.alias("thinking"), rid.alias("response_id"), row_ms.alias("row_ms"),
        F.when(k % 2 == 0, "gemini-3.8-flash-n").otherwise(F.col("model")).alias("served"), F.when(k % 5 == 0, "Gemini 3.8 Flash (High)").alias("display"), F.when(k % 6 == 0, "gemini-3.8-flash-high").alias("selected"),
    )
    if not copy:
        step = e.where("ordinal % 4 = 1 and ordinal % 3 <> 0").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        made = made.union(step.select(store, F.lit("step"), i * 2 + F.col("n"), none, none, none, none, none, none, rid, ms + 7 + F.col("n"), text, text, text))
    head = e.groupBy("session_id", "project").agg(F.min("ms").alias("ms"))
    made = made.union(head.select(store, F.lit("head"), F.lit(0).cast("long"), none, none, none, none, none, none, text, F.col("ms"), F.concat(F.lit("file://" + HOME + "/"), "project"), text, text)).select(*columns)
    return made.mapInPandas(_encoded, "store string, tbl string, id string, idx long, data binary, metadata binary")


def _told(spark, sf_dir) -> agy.Conversations:
    roots = [write_stores(_cells(spark, sf_dir, copy), shared_folder(spark), SHAPES) for copy in (False, True)]
    return agy.Conversations(*[stored(t) for t in agy.read_conversations(spark, roots)])


def store_generation_usage(spark, sf_dir):
    """Generations of all stores, each once, by the strongest evidence of its time."""
    told = _told(spark, sf_dir)
    used = agy.usage_events(told, HOME, stored(agy.generations(told)))
    return used.select("dedupe_key", "session_id", "evidence", F.unix_micros("at").alias("at_us"), "model", "project", "input", "output", "reasoning", "cache_read", "volume")


def store_generation_scan(spark, sf_dir):
    return agy.scan_stats(_told(spark, sf_dir))


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    body = F.to_json(_named(timestamp=F.col("ms"), conversationId=F.when(F.col("k") % 3 != 0, F.col("session_id"))))
    line = F.when(F.col("ordinal") % 19 == 0, "{").when(F.col("ordinal") % 17 == 0, "").otherwise(body)
    return e.select(F.lit("/logs/antigravity-cli/history.jsonl").alias("path"), _place(F.col("ordinal")).alias("pos"), line.alias("line"))


def cli_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each session and year: prompts, confirmations with and without conversation, other lines."""
    e = _events(spark, sf_dir)
    i, k = F.col("ordinal"), F.col("k")
    clock = F.concat(F.lit("I"), F.date_format("at", "MMdd HH:mm:ss"), F.lit("."), F.lpad((F.col("ms") % 1000 * 1000).cast("string"), 6, "0"), F.lit("  8577 x.go:34] "))
    said = F.when(k % 4 == 0, F.lit('HandleUserInput called with text: "Responding to tool confirmation convID=no"')).when(k % 4 == 1, _text("Responding to tool confirmation convID=c", F.floor(i / 40), ", grant command( ", F.col("tool_name"), " -x y)"))
    said = said.when(k % 4 == 2, F.lit("Responding to tool confirmation command()")).otherwise(F.lit("something else"))
    path = F.concat(F.lit("/logs/antigravity-cli/log/cli-"), F.year("at").cast("string"), F.lit("0101_"), F.col("session_id"), F.lit(".log"))
    return e.select(path.alias("path"), _place(i).alias("pos"), F.concat(F.when(i % 31 == 0, F.lit("I13")).otherwise(F.lit("")), clock, said).alias("line"))


def log_history_touches(spark, sf_dir):
    return agy.history_touches(stored(history_lines(spark, sf_dir))).select("session_id", F.unix_micros("at").alias("at_us"))


def log_cli_touches(spark, sf_dir):
    """Prompts and confirmations of text logs, with the conversation that holds there."""
    return agy.log_rows(stored(cli_lines(spark, sf_dir)), 3600).select("session_id", F.unix_micros("at").alias("at_us"))


def log_cli_grants(spark, sf_dir):
    grants = agy.log_tools(agy.log_rows(stored(cli_lines(spark, sf_dir)), 3600))
    return grants.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), F.min(F.unix_micros("at")).alias("first_us"))


CLI = f"""
{USAGE_SQL}, e AS (SELECT *, epoch_us("at") // 1000 AS ms FROM u WHERE provider = 'claude'),
c AS (
  SELECT *, k % 4 AS kind, last_value(CASE WHEN k % 4 = 1 THEN 'c' || (ordinal // 40) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS conv FROM e
), r AS (SELECT coalesce(conv, 'cli-' || year("at") || '0101_' || session_id) AS sid, (ms - 3600000) * 1000 AS at_us, kind, tool_name FROM c WHERE kind < 3 AND ordinal % 31 <> 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "store_generation_usage": f"""WITH {USAGE_SQL}, e AS (SELECT *, epoch_us("at") // 1000 AS ms, CASE WHEN ordinal % 3 <> 0 THEN 'r' || ordinal END AS rid FROM u WHERE provider = 'claude'),
          s AS (SELECT session_id, min(ms) AS begun, bool_or(k % 6 = 0) AS picked FROM e GROUP BY session_id),
          g AS (SELECT *, CASE WHEN ordinal % 4 = 0 OR (ordinal % 8 = 2 AND user_id % 2 = 0) THEN 3 WHEN ordinal % 4 = 1 AND rid IS NOT NULL THEN 2 ELSE 1 END AS evidence FROM e JOIN s USING (session_id) WHERE ordinal % 29 <> 0 AND ordinal % 23 <> 0)
          SELECT coalesce(rid, session_id || '#' || ordinal) AS dedupe_key, session_id, evidence::int AS evidence, 1000 * CASE evidence WHEN 3 THEN ms + CASE WHEN ordinal % 4 = 0 THEN 0 ELSE 9 END WHEN 2 THEN ms + 7 ELSE begun END AS at_us,
            CASE WHEN k % 5 = 0 THEN 'Gemini 3.8 Flash (High)' WHEN k % 2 = 0 THEN CASE WHEN picked THEN 'gemini-3.8-flash' ELSE 'gemini-3.8-flash-n' END ELSE model END AS model, project,
            k + input AS input, output + k % 7 AS output, k % 7 AS reasoning, cache_read, k + input + output + k % 7 + cache_read AS volume FROM g""",
        "store_generation_scan": f"WITH {USAGE_SQL}, e AS (SELECT *, ordinal % 29 <> 0 AND ordinal % 23 = 0 AS drift, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM u WHERE provider = 'claude') SELECT sum(n)::bigint AS rows, coalesce(sum(n) FILTER (WHERE drift), 0)::bigint AS parse_errors, 0::bigint AS cut_stores FROM e",
        "log_history_touches": f"""WITH {USAGE_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM u WHERE provider = 'claude')
          SELECT CASE WHEN k % 3 <> 0 THEN session_id ELSE 'history:' || n END AS session_id, epoch_us("at") // 1000000 * 1000000 AS at_us FROM e WHERE ordinal % 19 <> 0 AND ordinal % 17 <> 0""",
        "log_cli_touches": f"WITH {CLI} SELECT sid AS session_id, at_us FROM r",
        "log_cli_grants": f"WITH {CLI} SELECT sid AS session_id, CASE kind WHEN 1 THEN 'command:' || tool_name ELSE 'ToolConfirmation' END AS tool_name, count(*) AS calls, min(at_us) AS first_us FROM r WHERE kind > 0 GROUP BY 1, 2",
    }
