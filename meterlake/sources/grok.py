"""Sessions of the update logs with their summaries: projects, subagents and fork ancestry.

A fork copies its parent's updates and keeps their ids, so copies collapse in the merge; the
order of files decides whose session and project stay: ordinary sessions first, then forks by
their depth in the ancestry, then by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalar import bounded, project_from_cwd
from meterlake.operators.ancestry import depths
from meterlake.sources import text, updates
from meterlake.sources.text import bounded_json, count_at, plain_text_at, text_at


def read_summaries(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path and text of every ``summary.json``."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").option("wholetext", True).text(roots)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sessions(files: DataFrame, summaries: DataFrame, home: str) -> DataFrame:
    """Of each session folder among ``files(path)``: folder, kind, project, rank (fork, depth) and whether to read it.

    A folder whose summary does not parse is not read: it may hide a subagent, whose usage its
    coordinator counts already.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]+$", "")
    v = F.col("v")
    told = summaries.select(folder(F.col("path")).alias("folder"), bounded_json(F.col("text")).alias("v"))
    told = told.select(
        "folder", v.isNotNull().alias("fine"), text_at(v, "$.session_kind").alias("kind"), text_at(v, "$.parent_session_id").alias("parent"), project_from_cwd(bounded(plain_text_at(v, "$.info.cwd"), 4096), home).alias("project")
    )
    every = files.select(folder(F.col("path")).alias("folder")).distinct().join(told, "folder", "left").withColumn("node", F.substring_index("folder", "/", -1))
    every = every.withColumn("fine", F.coalesce("fine", F.lit(True)))
    found = depths(every.where("fine").select("node", "parent"))
    fork = F.col("kind").isNotNull().cast("int")
    rank = F.struct(fork.alias("fork"), F.when(fork == 1, F.coalesce("depth", F.lit(0))).otherwise(0).alias("depth"))
    return every.join(found, "node", "left").select("folder", "fine", F.col("kind").alias("session_kind"), "project", rank.alias("rank"))


def rows(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """:func:`updates.grok_rows` of readable sessions, with kind, project and rank of their files."""
    lines = updates.grok_rows(parsed).withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))
    return lines.join(known.where("fine").drop("fine"), "folder").drop("folder")


def _subagent() -> Column:
    return F.coalesce(F.col("session_kind").startswith("subagent"), F.lit(False))


def usage_events(told: DataFrame) -> DataFrame:
    """Usage of completed turns; a subagent's is its coordinator's and left out."""
    return updates.grok_usage(told.where(~_subagent()), ("project", "rank")).withColumn("source_kind", F.lit("main"))


def usage_of(lines: DataFrame, known: DataFrame) -> DataFrame:
    """:func:`usage_events` of lines yet to be parsed: those of unreadable sessions and of subagents are left out before."""
    mine = known.where("fine").where(~_subagent()).drop("fine", "session_kind")
    parsed = text.parse(lines.withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).join(mine, "folder").drop("folder"))
    kept = ("project", "rank")
    return updates.grok_usage(updates.grok_rows(parsed, kept), kept).withColumn("source_kind", F.lit("main"))


def durations(told: DataFrame) -> DataFrame:
    took = count_at(F.col("v"), "$.params.update.usage.apiDurationMs")
    out = told.where(~_subagent()).where("kind = 'turn_completed' and prompt_id is not null").withColumn("duration_ms", took).where("duration_ms > 0")
    return out.select("path", "pos", "rank", "at", "session_id", "duration_ms", F.lit(0).cast("long").alias("wait_ms"), F.lit(None).cast("long").alias("model_ms"), F.lit("turn").alias("status"), F.concat(F.lit("grok-duration:"), "prompt_id").alias("dedupe_key"))


def tool_events(told: DataFrame) -> DataFrame:
    v = F.col("v")
    calls = told.where("kind = 'tool_call'").withColumn("tool_name", text_at(v, "$.params.update.title")).where("tool_name is not null")
    kind = F.when(_subagent(), "subagent").otherwise("main")
    return calls.select("path", "pos", "rank", "at", "session_id", "tool_name", F.lit(None).cast("string").alias("subagent_type"), kind.alias("source_kind"), F.concat(F.lit("grok-tool:"), text_at(v, "$.params.update.toolCallId")).alias("dedupe_key"))


def touches(told: DataFrame) -> DataFrame:
    return told.where("at is not null and session_id is not null").select("path", "pos", "at", "session_id")
