"""Decoder of the first agent's transcripts: one JSON line for each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalar import bounded, clamp_counter, parse_instant, project_from_cwd
from meterlake.sources.text import array_at, count_at, flag_at, text_at

# Prompts that no person typed, and the texts that mark an interrupt.
GENERATED = ("<task-notification>", "<scheduled-task", "<bash-stdout>", "<bash-stderr>", "<local-command-stdout>", "<local-command-stderr>")
INTERRUPTS = ("[Request interrupted by user]", "[Request interrupted by user for tool use]")
QUESTION_TOOL = "AskUserQuestion"
COMPACT = "<command-name>/compact</command-name>"

USAGE = ("input", "output", "cache_creation", "cache_read", "w1h", "w5m")


def _any(blocks: Column, kind: str) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: text_at(b, "$.type") == kind), F.lit(False))


def prompt_text(v: Column) -> Column:
    """What a user row asks: its text, or its first text block unless it answers a tool."""
    blocks = array_at(v, "$.message.content")
    first = F.get(F.filter(blocks, lambda b: text_at(b, "$.type") == "text"), F.lit(0))
    text = F.when(blocks.isNotNull(), F.when(~_any(blocks, "tool_result"), F.try_variant_get(first, "$.text", "string"))).otherwise(F.try_variant_get(v, "$.message.content", "string"))
    return F.when((text_at(v, "$.type") == "user") & ~flag_at(v, "$.isSidechain") & ~flag_at(v, "$.isMeta"), text)


def is_human_turn(v: Column) -> Column:
    text = prompt_text(v)
    origin = F.coalesce(F.try_variant_get(v, "$.origin.kind", "string"), F.try_variant_get(v, "$.turnOrigin", "string"))
    generated = F.lit(False)
    for prefix in GENERATED:
        generated = generated | F.startswith(F.ltrim(text), F.lit(prefix))
    return F.coalesce(text.isNotNull() & ~flag_at(v, "$.isCompactSummary") & (origin.isNull() | (origin == "human")) & ~generated, F.lit(False))


def is_interrupt(v: Column) -> Column:
    blocks = array_at(v, "$.message.content")
    text = F.when(blocks.isNotNull(), F.when(F.size(blocks) == 1, F.try_variant_get(F.get(blocks, F.lit(0)), "$.text", "string"))).otherwise(F.try_variant_get(v, "$.message.content", "string"))
    shown = (text_at(v, "$.type") == "user") & ~flag_at(v, "$.isMeta") & ~flag_at(v, "$.isSidechain")
    return F.coalesce(shown & F.trim(text).isin(*INTERRUPTS), F.lit(False))


def rows(parsed: DataFrame, home: str) -> DataFrame:
    """Common columns of each readable line, and the project carried along the file."""
    v = F.col("v")
    line = Window.partitionBy("path").orderBy("pos")
    cwd = F.first(text_at(v, "$.cwd", 4096), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    folder = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    label = F.when(folder != "", F.regexp_replace(F.regexp_replace(folder, "^-+", ""), "^(Users|home)-[^-]+-", ""))
    main = ~F.col("path").rlike("/subagents/")
    side = flag_at(v, "$.isSidechain") | ~main
    agent_file = F.regexp_extract("path", r"/agent-([^/]+)\.jsonl$", 1)
    out = parsed.where("v is not null").select(
        "path", "pos", "v", parse_instant(F.try_variant_get(v, "$.timestamp", "string")).alias("at"), text_at(v, "$.type").alias("type"),
        F.coalesce(text_at(v, "$.sessionId"), text_at(v, "$.session_id"), text_at(v, "$.session_id_v2")).alias("session_id"),
        text_at(v, "$.uuid").alias("uuid"), main.alias("main_file"), F.when(side, "subagent").otherwise("main").alias("source_kind"),
        F.coalesce(text_at(v, "$.attributionAgent"), text_at(v, "$.attribution_agent"), F.when(side & (agent_file != ""), agent_file)).alias("agent"),
        F.coalesce(text_at(v, "$.attributionSkill"), text_at(v, "$.attribution_skill")).alias("skill"),
        F.coalesce(project_from_cwd(cwd, home), label).alias("project"), text_at(v, "$.message.id").alias("message_id"),
        F.coalesce(text_at(v, "$.message.model"), text_at(v, "$.model")).alias("model"),
    )
    return out.withColumn("talk", F.col("type").isin("user", "assistant") & F.try_variant_get("v", "$.message", "variant").isNotNull())


def _usage(u: Column) -> list[Column]:
    fields = {"input": "$.input_tokens", "output": "$.output_tokens", "cache_creation": "$.cache_creation_input_tokens", "cache_read": "$.cache_read_input_tokens"}
    fields |= {"w1h": "$.cache_creation.ephemeral_1h_input_tokens", "w5m": "$.cache_creation.ephemeral_5m_input_tokens"}
    used = F.filter(F.map_entries(F.try_variant_get(u, "$.server_tool_use", "map<string, variant>")), lambda e: (count_at(e["value"], "$") > 0) & bounded(e["key"]).isNotNull())
    tools = F.map_from_entries(F.transform(used, lambda e: F.struct(e["key"], clamp_counter(count_at(e["value"], "$")))))
    return [*[clamp_counter(count_at(u, p)).alias(k) for k, p in fields.items()], tools.alias("server_tools")]


def usage_events(decoded: DataFrame) -> DataFrame:
    """One event a message, and one more for each advisor iteration; all-zero usage is none."""
    base = ["path", "pos", "at", "session_id", "source_kind", "agent", "skill", "project"]
    talk = decoded.where("talk").withColumn("u", F.coalesce(F.try_variant_get("v", "$.message.usage", "variant"), F.try_variant_get("v", "$.usage", "variant")))
    own = talk.select(*base, "model", F.concat(F.lit("message:"), "message_id").alias("dedupe_key"), *_usage(F.col("u")))
    steps = talk.select(*base, "model", "message_id", F.posexplode(array_at(F.col("u"), "$.iterations")).alias("i", "s")).where(text_at(F.col("s"), "$.type") == "advisor_message")
    key = F.concat(F.lit("message:"), "message_id", F.lit(":iter:"), F.col("i").cast("string"))
    more = steps.select(*base, F.coalesce(text_at(F.col("s"), "$.model"), "model").alias("model"), key.alias("dedupe_key"), *_usage(F.col("s")))
    every = own.union(more).withColumn("volume", F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read"))
    return every.where("volume > 0").withColumn("granularity", F.lit("call"))


def tool_events(decoded: DataFrame) -> DataFrame:
    blocks = decoded.where("talk").select("path", "pos", "at", "session_id", "source_kind", F.posexplode(array_at(F.col("v"), "$.message.content")).alias("i", "b"))
    b = F.col("b")
    key = F.coalesce(F.concat(F.lit("tool:"), text_at(b, "$.id")), F.concat_ws(":", "path", F.to_json("pos"), F.col("i").cast("string")))
    out = blocks.where(text_at(b, "$.type") == "tool_use")
    return out.select("path", "pos", "at", "session_id", "source_kind", text_at(b, "$.name").alias("tool_name"), text_at(b, "$.input.subagent_type").alias("subagent_type"), key.alias("dedupe_key")).where("tool_name is not null")


def touches(decoded: DataFrame) -> DataFrame:
    return decoded.where("at is not null and session_id is not null").select("at", "session_id")


def mode_events(decoded: DataFrame) -> DataFrame:
    v = F.col("v")
    rows_ = decoded.where("talk and type = 'assistant' and message_id is not null")
    fast = F.coalesce(F.try_variant_get(v, "$.message.usage.speed", "string") == "fast", F.lit(False))
    return rows_.select("pos", "at", _any(array_at(v, "$.message.content"), "thinking").alias("has_thinking"), fast.alias("fast"), F.concat(F.lit("mode:"), "message_id").alias("dedupe_key"))


def effort_events(decoded: DataFrame) -> DataFrame:
    out = decoded.where("talk and type = 'assistant' and message_id is not null")
    return out.select("pos", "at", text_at(F.col("v"), "$.effort").alias("effort"), F.concat(F.lit("claude-effort:"), "message_id").alias("dedupe_key")).where("effort is not null")


def permission_events(decoded: DataFrame) -> DataFrame:
    out = decoded.where("talk and uuid is not null").where(is_human_turn(F.col("v")))
    return out.select("pos", "at", text_at(F.col("v"), "$.permissionMode").alias("mode"), F.concat(F.lit("claude-permission:"), "uuid").alias("dedupe_key")).where("mode is not null")


def interrupt_events(decoded: DataFrame) -> DataFrame:
    out = decoded.where("talk and main_file and uuid is not null").where(is_interrupt(F.col("v")))
    return out.select("pos", "at", F.concat(F.lit("claude-interrupt:"), "uuid").alias("dedupe_key"))


def turn_rows(decoded: DataFrame) -> DataFrame:
    """The narrow columns that the turn machine reads, of main files only."""
    v = F.col("v")
    blocks = array_at(v, "$.message.content")
    asked = F.transform(F.filter(blocks, lambda b: (text_at(b, "$.type") == "tool_use") & (text_at(b, "$.name") == QUESTION_TOOL)), lambda b: text_at(b, "$.id"))
    answered = F.transform(F.filter(blocks, lambda b: text_at(b, "$.type") == "tool_result"), lambda b: F.try_variant_get(b, "$.tool_use_id", "string"))
    prompt = prompt_text(v)
    human = is_human_turn(v)
    kind = F.when(is_interrupt(v), "interrupt").when(human, "human").when(prompt.isNotNull(), "generated").when(F.col("type") == "assistant", "assistant").otherwise("other")
    return decoded.where("main_file").select(
        "path", "pos", F.unix_micros("at").alias("at"), "session_id", "uuid", kind.alias("kind"), F.coalesce(prompt.contains(COMPACT), F.lit(False)).alias("compact"),
        F.when(F.col("type") == "assistant", F.filter(asked, lambda x: x.isNotNull())).alias("asked"), F.when(F.col("type") == "user", F.filter(answered, lambda x: x.isNotNull())).alias("answered"),
    )
