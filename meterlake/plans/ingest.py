"""From log lines of several agents to one stream of usage events that every report takes.

``usage_stream(spark, {"claude": ["/logs/a"], "codex": ["/logs/b"]}, home, window)`` reads
folders of logs; the result stands in for the folder of a report::

    reports.model_stats(spark, usage_stream(...))
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalar import local_time
from meterlake.functions.tables import shared_folder, stored
from meterlake.operators import dedupe
from meterlake.plans.adapter import Stream, Window
from meterlake.sources import claude, codex, text, updates

__all__ = ["AGENTS", "dated", "shared_folder", "stored", "united", "usage_stream"]

COUNTERS = ("input", "output", "cache_read", "cache_creation", "w5m", "w1h")
METADATA = ("session_id", "model", "project", "source_kind", "agent", "skill")


class Agent(NamedTuple):
    """File names of an agent's logs, and its usage events from parsed lines and the home folder."""

    pattern: str
    usage: Callable[[DataFrame, str], DataFrame]


AGENTS = {
    "claude": Agent("*.jsonl*", lambda parsed, home: claude.usage_events(stored(claude.rows(parsed, home)))),
    "codex": Agent("*.jsonl*", lambda parsed, home: codex.usage_events(stored(codex.rows(parsed, home)))),
    "grok": Agent("updates.jsonl", lambda parsed, _: updates.grok_usage(stored(updates.grok_rows(parsed)))),
    "copilot": Agent("events.jsonl", lambda parsed, _: updates.copilot_usage(stored(updates.copilot_rows(parsed)))),
}


def _even(events: DataFrame, provider: str) -> DataFrame:
    """The common columns; counters that an agent does not report are 0."""
    kinds = {c: "long" for c in COUNTERS} | {c: "string" for c in METADATA}
    stand = {c: F.lit(0 if k == "long" else "main" if c == "source_kind" else None).cast(k) for c, k in kinds.items()}
    columns = [F.col(c) if c in events.columns else stand[c].alias(c) for c in kinds]
    return events.select(F.lit(provider).alias("provider"), "path", "pos", "at", "dedupe_key", "granularity", "volume", *columns)


def united(lines: dict[str, DataFrame], home: str) -> DataFrame:
    """Usage of all agents, replayed records merged: one row for each provider and key.

    ``lines`` holds path, pos and line for each agent. Rows without a key stay as they are.
    """
    every = None
    for provider, rows in lines.items():
        one = stored(_even(AGENTS[provider].usage(text.parse(rows), home), provider))
        every = one if every is None else every.union(one)
    key = ["provider", "dedupe_key"]
    fold = lambda rows: dedupe.merge_usage(rows, key, "volume", ["path", "pos"], "at", ["granularity", *COUNTERS], list(METADATA))
    return dedupe.keyed(every, "dedupe_key", fold)


def dated(usage: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """Adds the local day and hour; ``at`` becomes local and zone-free."""
    out = usage.withColumn("at", local_time(F.col("at"), offset_seconds))
    place = F.xxhash64("provider", "dedupe_key", "session_id", F.col("at").cast("string"), "volume")
    return out.withColumns({"d": F.to_date("at"), "h": F.hour("at"), "ordinal": place})


def usage_stream(spark: SparkSession, roots: dict[str, list[str]], home: str, window: Window, offset_seconds: int = 0) -> Stream:
    """The stream of all agents' log folders, for any report over usage."""
    lines = {p: text.read_lines(spark, folders, AGENTS[p].pattern) for p, folders in roots.items()}
    return Stream(dated(united(lines, home), offset_seconds), window)
