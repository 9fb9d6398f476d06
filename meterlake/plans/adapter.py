"""The driver's tables seen as event streams.

The tables hold no agent logs, so their columns are re-read as usage, tools, turns,
limits and credits by fixed formulas. :data:`USAGE_SQL` is the same view in DuckDB.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Window(NamedTuple):
    """Inclusive local dates, and the first date of the window before."""

    start: date
    end: date
    prev_start: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


WINDOW = Window(date(2024, 1, 17), date(2024, 1, 30), date(2024, 1, 3))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Stream(NamedTuple):
    """Usage events of one's own, with their window: reports take it in place of a folder.

    ``events`` is the tagged table of all kinds (see streams.py); without it only reports over
    usage can be had. ``kinds`` are those that were read, where not all were; without usage
    among them ``usage`` is none.
    """

    usage: DataFrame | None
    window: Window
    events: DataFrame | None = None
    kinds: frozenset[str] | None = None


def window_of(source: str | Stream) -> Window:
    return source.window if isinstance(source, Stream) else WINDOW


def usage_events(spark: SparkSession, sf_dir: str | Stream) -> DataFrame:
    if isinstance(sf_dir, Stream):
        if sf_dir.usage is None:
            raise ValueError("this stream was read without usage")
        return sf_dir.usage
    e = read(spark, sf_dir, "events")
    i, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    duration = F.floor(value * 20000).cast("long")
    names = {"view": "claude-opus-4-8", "click": "claude-haiku-5-5", "signup": "gpt-6.1-sol", "purchase": "claude-sonnet-4-5-20250929", "error": "unlisted-model"}
    model = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in names.items()])
    out = e.select(
        i.alias("ordinal"), F.col("ts").alias("at"), F.to_date("ts").alias("d"), F.hour("ts").alias("h"),
        F.concat(F.lit("s"), user.cast("string")).alias("session_id"), user.alias("user_id"),
        F.when(user % 3 == 0, "claude").when(user % 3 == 1, "codex").otherwise("opencode").alias("provider"),
        k.alias("k"), model.alias("model"),
        (k * 100 + 1).alias("input"), F.floor(value * 10).cast("long").alias("output"),
        (k * 2000).alias("cache_read"), ((i % 11) * 3000).alias("cache_creation"), ((i % 11) * 1000).alias("w5m"), ((i % 11) * 1500).alias("w1h"),
        F.when(i % 7 == 0, "subagent").otherwise("main").alias("source_kind"), F.when(i % 10 == 0, "aggregate").otherwise("call").alias("granularity"),
        F.when(i % 14 == 0, "Explore").alias("agent"), F.when(k % 5 == 0, F.concat(F.lit("skill-"), (k % 3).cast("string"))).alias("skill"),
        F.concat(F.lit("work/p"), (user % 4).cast("string")).alias("project"),
        F.when(i % 21 == 0, "Agent").otherwise(F.col("event_type")).alias("tool_name"),
        duration.alias("duration_ms"), F.when(k % 4 == 0, F.floor(duration / 4)).otherwise(0).cast("long").alias("wait_ms"),
        F.when(k % 3 != 0, F.floor(duration / 2)).cast("long").alias("model_ms"),
    )
    return out.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))


#: How a folder's rows are seen as each kind of event: a filter, and the columns that have other names.
VIEWS = {
    "tool": ("true", {"subagent_type": "agent"}), "touch": ("true", {}), "turn": ("true", {"status": "'turn'"}), "credit": ("provider = 'opencode'", {"nano_aiu": "k * 1000000"}),
    "limit": ("provider = 'codex' and k % 9 = 0 and day(d) % 3 <> 0", {"used_percent": "cast(k as double)"}), "mode": ("true", {"has_thinking": "k % 2 = 0", "fast": "k % 10 = 0"}), "effort": ("true", {"effort": "concat('effort-', k % 4)"}),
    "permission": ("k % 3 <> 2", {"mode": "if(k % 3 = 0, 'plan', 'ask')"}), "interrupt": ("ordinal % 50 = 0", {}),
}


def kind_of(spark: SparkSession, source: str | Stream, kind: str) -> DataFrame:
    """Events of one kind: of a stream's table, or the folder's rows seen as such."""
    if isinstance(source, Stream):
        if source.events is None:
            raise ValueError(f"this stream has usage alone, no {kind} events")
        if source.kinds is not None and kind not in source.kinds:
            raise ValueError(f"this stream was read without {kind} events")
        return source.events.where(F.col("kind") == kind)
    which, names = VIEWS[kind]
    return usage_events(spark, source).where(which).withColumns({c: F.expr(e) for c, e in names.items()})


USAGE_SQL = """
u0 AS (
  SELECT event_id AS ordinal, ts AS "at", ts::date AS d, hour(ts)::int AS h, 's' || user_id AS session_id, user_id,
    CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'opencode' END AS provider,
    regexp_extract(props, '[0-9]+')::bigint AS k, event_id, event_type, value,
    CASE event_type WHEN 'view' THEN 'claude-opus-4-8' WHEN 'click' THEN 'claude-haiku-5-5' WHEN 'signup' THEN 'gpt-6.1-sol'
      WHEN 'purchase' THEN 'claude-sonnet-4-5-20250929' WHEN 'error' THEN 'unlisted-model' END AS model,
    floor(value * 20000)::bigint AS duration_ms
  FROM events
), u AS (
  SELECT *, k * 100 + 1 AS input, floor(value * 10)::bigint AS output, k * 2000 AS cache_read, (event_id % 11) * 3000 AS cache_creation,
    (event_id % 11) * 1000 AS w5m, (event_id % 11) * 1500 AS w1h,
    CASE WHEN event_id % 7 = 0 THEN 'subagent' ELSE 'main' END AS source_kind, CASE WHEN event_id % 10 = 0 THEN 'aggregate' ELSE 'call' END AS granularity,
    CASE WHEN event_id % 14 = 0 THEN 'Explore' END AS agent, CASE WHEN k % 5 = 0 THEN 'skill-' || (k % 3) END AS skill, 'work/p' || (user_id % 4) AS project,
    CASE WHEN event_id % 21 = 0 THEN 'Agent' ELSE event_type END AS tool_name,
    CASE WHEN k % 4 = 0 THEN duration_ms // 4 ELSE 0 END AS wait_ms, CASE WHEN k % 3 <> 0 THEN duration_ms // 2 END AS model_ms,
    k * 100 + 1 + floor(value * 10)::bigint + k * 2000 + (event_id % 11) * 3000 AS volume
  FROM u0
), w AS (SELECT * FROM u WHERE d BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'),
cal AS (SELECT unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY))::date AS d)
"""


def in_window(events: DataFrame, window: Window, undated: bool = False) -> DataFrame:
    inside = F.col("d").between(F.lit(window.start), F.lit(window.end))
    return events.where(inside | F.col("d").isNull() if undated else inside)


def calendar(spark: SparkSession, window: Window) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(window.start), F.lit(window.end))).alias("d"))
