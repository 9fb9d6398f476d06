"""Decoders of two smaller log formats: turn updates, and session event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalar import ID_BYTES, bounded, clamp_counter, from_seconds, parse_instant, saturating_sub
from meterlake.operators.sequence import deltas
from meterlake.sources.text import count_at, long_at, plain_text_at, text_at


def grok_rows(parsed: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Lines of ``<cwd>/<session>/updates.jsonl``: epoch seconds, the session is the folder. ``kept`` columns pass."""
    v = F.col("v")
    session = bounded(F.regexp_extract("path", r"/([^/]+)/updates\.jsonl$", 1))
    # each value is taken once, in a list of one below all that uses it: a typed value of a variant is the dearest step here
    found = F.struct(long_at(v, "$.timestamp").alias("seconds"), plain_text_at(v, "$.params.update.sessionUpdate").alias("kind"), plain_text_at(v, "$.params.update.prompt_id").alias("prompt_id"))
    told = parsed.where("v is not null").select("path", "pos", "v", *kept, F.explode_outer(F.array(found)).alias("x"))
    at = from_seconds(F.when(F.col("x.seconds") >= 0, F.col("x.seconds")))
    short = lambda c: F.when(F.octet_length(c).between(1, ID_BYTES), c)
    return told.select("path", "pos", "v", at.alias("at"), session.alias("session_id"), short(F.col("x.kind")).alias("kind"), short(F.col("x.prompt_id")).alias("prompt_id"), *kept)


def grok_usage(rows: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Usage of completed turns, one event a model; all models together where none is named. ``kept`` columns pass."""
    v = F.col("v")
    done = rows.where("kind = 'turn_completed' and prompt_id is not null")
    models = F.try_variant_get(v, "$.params.update.usage.modelUsage", "map<string, variant>")
    whole = F.try_variant_get(v, "$.params.update.usage", "variant")
    # outer lists, as Spark puts the list of an inner one into filters below it and decodes it there again
    each = done.select("path", "pos", "at", "session_id", "prompt_id", *kept, whole.alias("whole"), F.explode_outer(F.map_entries(models)).alias("e"))
    own = F.col("e").isNull()
    each = each.where(own | bounded(F.col("e.key")).isNotNull()).withColumns({"model": F.col("e.key"), "u": F.when(own, F.col("whole")).otherwise(F.col("e.value"))})
    names = {"raw_input": "inputTokens", "output": "outputTokens", "reasoning": "reasoningTokens", "cache_creation": "cacheCreationTokens", "cache_read": "cachedReadTokens"}
    # of negative integers clamp_counter makes 0, as of what is none
    counts = F.struct(*[clamp_counter(long_at(F.col("u"), f"$.{p}")).alias(k) for k, p in names.items()])
    each = each.select("path", "pos", "at", "session_id", *kept, "model", F.concat_ws(":", F.lit("grok"), "prompt_id", "model").alias("dedupe_key"), F.explode_outer(F.array(counts)).alias("c"))
    fresh = saturating_sub(saturating_sub(F.col("c.raw_input"), F.col("c.cache_read")), F.col("c.cache_creation"))
    out = each.select("path", "pos", "at", "session_id", *kept, "model", "dedupe_key", fresh.alias("input"), *[F.col("c")[k].alias(k) for k in ("output", "reasoning", "cache_creation", "cache_read")])
    return out.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read")).where("volume > 0").withColumn("granularity", F.lit("aggregate"))


def grok_durations(rows: DataFrame) -> DataFrame:
    took = count_at(F.col("v"), "$.params.update.usage.apiDurationMs")
    out = rows.where("kind = 'turn_completed' and prompt_id is not null")
    return out.select("at", "session_id", took.alias("duration_ms"), F.concat(F.lit("grok-duration:"), "prompt_id").alias("dedupe_key")).where("duration_ms > 0")


def copilot_rows(parsed: DataFrame) -> DataFrame:
    """Lines of ``session-state/<session>/events.jsonl``."""
    v = F.col("v")
    session = bounded(F.regexp_extract("path", r"/session-state/([^/]+)/events\.jsonl$", 1))
    return parsed.where("v is not null").select("path", "pos", "v", parse_instant(F.try_variant_get(v, "$.timestamp", "string")).alias("at"), session.alias("session_id"), text_at(v, "$.type").alias("type"), text_at(v, "$.id").alias("id"))


def copilot_usage(rows: DataFrame) -> DataFrame:
    """Cumulative shutdown snapshots by model, as differences.

    Undated snapshots and those without both core counters don't move the baseline.
    """
    dated = (F.col("type") == "session.shutdown") & F.col("at").isNotNull()
    rows = rows.withColumn("nth", F.count_if(dated).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    metrics = F.try_variant_get(F.col("v"), "$.data.modelMetrics", "map<string, variant>")
    each = rows.where("type = 'session.shutdown' and at is not null").select("path", "pos", "at", "session_id", "id", "nth", F.explode(metrics).alias("model", "m"))
    each = each.where(count_at(F.col("m"), "$.usage.inputTokens").isNotNull() & count_at(F.col("m"), "$.usage.outputTokens").isNotNull() & bounded(F.col("model")).isNotNull())
    names = {"raw_input": "inputTokens", "output": "outputTokens", "cache_read": "cacheReadTokens", "cache_creation": "cacheWriteTokens", "reasoning": "reasoningTokens"}
    each = each.select("*", *[clamp_counter(count_at(F.col("m"), f"$.usage.{p}")).alias(k) for k, p in names.items()])
    made = deltas(each, ["path", "model"], ["pos"], list(names))
    fresh = saturating_sub(saturating_sub(F.col("d_raw_input"), F.col("d_cache_read")), F.col("d_cache_creation"))
    # without an id the place of the shutdown in its session
    key = F.coalesce(F.concat(F.lit("copilot:"), "id", F.lit(":"), "model"), F.concat(F.lit("copilot:"), "session_id", F.lit(":"), "model", F.lit(":"), F.col("nth").cast("string")))
    out = made.select("path", "pos", "at", "session_id", "model", key.alias("dedupe_key"), fresh.alias("input"), *[F.col(f"d_{k}").alias(k) for k in ("output", "reasoning", "cache_creation", "cache_read")])
    return out.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read")).where("volume > 0").withColumn("granularity", F.lit("aggregate"))


def copilot_turns(rows: DataFrame) -> DataFrame:
    """Pairs each turn's end with its latest start; an end before its start pairs with nothing."""
    marks = rows.where("type in ('assistant.turn_start', 'assistant.turn_end') and at is not null").withColumn("turn_id", text_at(F.col("v"), "$.data.turnId"))
    line = Window.partitionBy("path", "turn_id").orderBy("pos")
    begun = F.last(F.when(F.col("type") == "assistant.turn_start", F.struct("at", "pos")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ends = marks.withColumn("begun", begun).where("type = 'assistant.turn_end' and begun is not null and at >= begun.at")
    first = ends.withColumn("n", F.row_number().over(Window.partitionBy("path", "turn_id", "begun.pos").orderBy("pos"))).where("n = 1")
    return first.select("path", "pos", "at", "session_id", F.timestamp_diff("MILLISECOND", F.col("begun.at"), F.col("at")).alias("duration_ms"))


def copilot_tools(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    calls = rows.where("type = 'tool.execution_start'")
    return calls.select("at", "session_id", text_at(v, "$.data.toolName").alias("tool_name"), F.concat(F.lit("copilot:tool:"), text_at(v, "$.data.toolCallId")).alias("dedupe_key")).where("tool_name is not null")


def copilot_credits(rows: DataFrame) -> DataFrame:
    """Cumulative checkpoints of credits, as differences."""
    nano = count_at(F.col("v"), "$.data.totalNanoAiu")
    marks = rows.where("type = 'session.usage_checkpoint' and at is not null").select("path", "pos", "at", "session_id", nano.alias("nano")).where("nano is not null")
    return deltas(marks, ["path"], ["pos"], ["nano"]).select("at", "session_id", F.col("d_nano").alias("nano_aiu")).where("nano_aiu > 0")
