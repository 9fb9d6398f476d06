"""Decoder of the second agent's rollouts: typed lines whose context carries forward."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import command
from meterlake.functions.scalar import clamp_counter, parse_instant, project_from_cwd, saturating_sub
from meterlake.sources.text import bounded_json, count_at, number_at, plain_text_at, text_at

COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def rows(parsed: DataFrame, home: str, values: Callable[[Column], list[Column]] | None = None, which: str = "true") -> DataFrame:
    """Each readable line with the session, model and project that hold there.

    Every session_meta moves the session (before the first: the file's name) and the project;
    metas and turn contexts move the model, even those of copies. A fork is a first meta that
    names what it was forked from without a history base, or a second meta: lines from its
    second until less than a second after it are copies, except the first meta and the usage
    records of the file's own thread. The first meta also tells whose file it is.

    ``values`` are read from each line before the lines are ordered, and stand in the place of
    its variant, which is then not sorted. ``which`` keeps some lines besides metas; models and
    line numbers are then those of the lines kept.
    """
    v = F.col("v")
    line = Window.partitionBy("path").orderBy("pos")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = text_at(v, "$.type")
    own = [v] if values is None else values(v)
    base = parsed.where("v is not null").select("path", "pos", "v", kind.alias("type"), F.try_variant_get(v, "$.timestamp", "string").alias("raw_at"))
    meta, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    carry = lambda c: F.last(c, ignorenulls=True).over(upto)
    first = meta & (F.col("metas") == 1)
    present = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("VOID")) != "VOID"
    forked = F.when((first & F.col("__copied")) | (meta & (F.col("metas") == 2)), F.struct("at"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.jsonl(\.zst)?$", "")
    spawn = F.try_variant_get(v, "$.payload.source.subagent.thread_spawn", "variant")
    role = F.coalesce(text_at(v, "$.payload.source.subagent.thread_spawn.agent_role"), text_at(v, "$.payload.source.subagent.thread_spawn.agent_type"), text_at(v, "$.payload.agent_role"), F.lit("default"))
    other = F.coalesce(text_at(v, "$.payload.source.subagent"), text_at(v, "$.payload.source.subagent.other"), F.get(F.map_keys(F.try_variant_get(v, "$.payload.source.subagent", "map<string, variant>")), F.lit(0)), F.lit("subagent"))
    agent = F.when(present("$.payload.source.subagent"), F.when(spawn.isNotNull(), role).otherwise(other)).otherwise(text_at(v, "$.payload.source.internal"))
    model = F.coalesce(text_at(v, "$.payload.model"), F.when(meta, F.coalesce(text_at(v, "$.payload.collaboration_mode.settings.model"), text_at(v, "$.payload.model_provider"))))
    # what the lines say, of metas and contexts alone, before they are ordered
    said = {
        "__id": F.when(meta, text_at(v, "$.payload.id")), "__model": F.when(meta | context, model), "__project": F.when(meta, F.struct(project_from_cwd(text_at(v, "$.payload.cwd", 4096), home).alias("p"))), "__agent": F.when(meta, agent),
        "__copied": F.when(meta, present("$.payload.forked_from_id") & ~present("$.payload.history_base")), "__owner": F.when(F.col("type") == "token_usage_record", text_at(v, "$.payload.thread_id")),
    }
    base = base.select("path", "pos", *own, "type", "raw_at", parse_instant(F.col("raw_at")).alias("at"), *[c.alias(k) for k, c in said.items()]).where(F.expr(which) | meta)
    # two passes over a file: what holds at each line, then what follows from the count of metas
    out = base.withColumns({
        "line_index": F.row_number().over(line), "metas": F.count_if(meta).over(upto), "session_id": F.coalesce(carry("__id"), F.nullif(stem, F.lit(""))),
        "model": F.coalesce(carry("__model"), F.lit("codex")), "project": carry("__project")["p"],
    })
    once = lambda c: F.first(F.when(first, F.col(c)), ignorenulls=True).over(upto)
    out = out.withColumns({"forked_at": carry(forked)["at"], "own_id": once("__id"), "agent": once("__agent")})
    own = first | F.coalesce(F.col("__owner") == F.col("own_id"), F.lit(False))
    burst = (F.col("at") >= F.date_trunc("second", "forked_at")) & (F.col("at") < F.col("forked_at") + F.expr("INTERVAL 1 SECOND"))
    return out.withColumn("copied", F.coalesce(burst, F.lit(False)) & ~F.coalesce(own, F.lit(False))).drop(*said)


def _fingerprint(v: Column, path: str) -> Column:
    return F.concat_ws(":", *[clamp_counter(count_at(v, f"{path}.{c}")).cast("string") for c in COUNTERS])


def _fields(v: Column, path: str) -> list[Column]:
    return [clamp_counter(count_at(v, f"{path}.{c}")).alias(c) for c in COUNTERS if c != "total_tokens"]


def _usage(events: DataFrame) -> DataFrame:
    """Counters from :func:`_fields`, each of which is read once."""
    uncached = saturating_sub(F.col("input_tokens"), F.col("cached_input_tokens"))
    write = F.least("cache_write_input_tokens", uncached)
    names = [(uncached - write).alias("input"), F.col("output_tokens").alias("output"), F.col("reasoning_output_tokens").alias("reasoning"), write.alias("cache_creation"), F.col("cached_input_tokens").alias("cache_read")]
    return events.where("input_tokens + output_tokens > 0").select(*[c for c in events.columns if c not in COUNTERS], *names)


def usage_events(decoded: DataFrame) -> DataFrame:
    """Usage records, and token counts that no earlier record of the file reports.

    Echoes are found by a window over narrow rows of both. A join would broadcast all records:
    Spark takes them for a small part of the table, most of which it counts for the variants.
    """
    v = F.col("v")
    own = decoded.where("not copied")
    base = ["path", "pos", "at", "session_id", "model", "project", "agent", "line_index"]
    place = F.concat_ws(":", F.col("session_id"), "raw_at", F.col("line_index").cast("string"))
    owner = text_at(v, "$.payload.thread_id")
    mine = owner.isNull() | F.col("own_id").isNull() | (owner == F.col("own_id"))
    key = F.coalesce(F.concat(F.lit("codex-usage:v3:"), text_at(v, "$.payload.response_id")), F.when(F.col("session_id").isNotNull() & F.col("at").isNotNull(), F.concat(F.lit("codex-record:"), place)))
    first = own.where("type = 'token_usage_record'").where(count_at(v, "$.payload.usage.total_tokens").isNotNull())
    first = first.select(*base, F.lit(True).alias("record"), mine.alias("mine"), _fingerprint(v, "$.payload.usage").alias("print"), key.alias("dedupe_key"), *_fields(v, "$.payload.usage"))
    last = _fingerprint(v, "$.payload.info.last_token_usage")
    total = F.when(count_at(v, "$.payload.info.total_token_usage.total_tokens").isNotNull(), _fingerprint(v, "$.payload.info.total_token_usage"))
    counted = F.when(F.col("session_id").isNotNull() & total.isNotNull(), F.concat_ws(":", F.lit("codex-usage:v2"), "session_id", last, total)).when(F.col("session_id").isNotNull() & F.col("at").isNotNull(), F.concat(F.lit("codex:"), place))
    second = own.where("type = 'event_msg'").where(text_at(v, "$.payload.type") == "token_count")
    second = second.select(*base, F.lit(False).alias("record"), F.lit(False).alias("mine"), last.alias("print"), counted.alias("dedupe_key"), *_fields(v, "$.payload.info.last_token_usage"))
    upto = Window.partitionBy("path", "print").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = first.union(second).withColumn("records", F.count_if("record").over(upto)).where("mine or records = 0")
    every = _usage(told.drop("line_index", "record", "mine", "print", "records"))
    return every.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_creation") + F.col("cache_read")).withColumn("granularity", F.lit("call")).withColumn("source_kind", F.when(F.col("agent").isNull(), "main").otherwise("subagent"))


def rate_limits(decoded: DataFrame) -> DataFrame:
    """Samples of the primary limit; a replayed one shares the key of counters, percent and window."""
    v = F.col("v")
    used = number_at(v, "$.payload.rate_limits.primary.used_percent")
    counts = decoded.where("not copied and type = 'event_msg' and at is not null").where(text_at(v, "$.payload.type") == "token_count").where(used.isNotNull())
    percent = F.least(F.greatest(used, F.lit(0.0)), F.lit(100.0))
    known = lambda p: F.when(count_at(v, f"{p}.total_tokens").isNotNull(), _fingerprint(v, p))
    window = [clamp_counter(count_at(v, f"$.payload.rate_limits.primary.{c}")).cast("string") for c in ("window_minutes", "resets_at")]
    state = F.concat(F.lit("codex-limit:v2:"), "session_id", F.lit(":"), known("$.payload.info.last_token_usage"), F.lit(":"), known("$.payload.info.total_token_usage"), F.lit(":"), percent.cast("string"), F.lit(":"), window[0], F.lit(":"), window[1])
    return counts.select("path", "pos", "at", "session_id", percent.alias("used_percent"), F.coalesce(state, _positional("codex-limit")).alias("dedupe_key"))


def _positional(prefix: str) -> Column:
    """Session, instant and line: stable for copies of whole files."""
    return F.concat(F.lit(f"{prefix}:"), "session_id", F.lit(":"), F.unix_micros("at").cast("string"), F.lit(":"), F.col("line_index").cast("string"))


# Payload types that begin or end a turn, and item types that are the model's own.
LIFECYCLE = ("task_started", "turn_aborted", "task_complete")
MODEL_ITEMS = ("Reasoning", "AgentMessage", "ContextCompaction", "UserMessage")
# Fixed value: a longer pause before a prompt is absence, in microseconds.
ABSENCE = 30 * 60 * 1_000_000


# Fixed value: the messages that turns and paces are made of.
TOLD = (*LIFECYCLE, "item_completed", "user_message")


def _message(v: Column) -> list[Column]:
    return [
        text_at(v, "$.payload.type").alias("kind"), count_at(v, "$.payload.duration_ms").alias("duration_ms"), count_at(v, "$.payload.started_at_ms").alias("start"), count_at(v, "$.payload.completed_at_ms").alias("end"),
        text_at(v, "$.payload.item.id").alias("item_id"), text_at(v, "$.payload.item.type").alias("item_type"),
    ]


def messages(decoded: DataFrame) -> DataFrame:
    """Narrow rows of the event messages that turns and paces are made of; worth storing before both."""
    own = decoded.where("not copied and type = 'event_msg'").select("path", "pos", "at", "session_id", *_message(F.col("v")))
    return own.where(F.col("kind").isin(*TOLD))


def told(parsed: DataFrame, home: str) -> DataFrame:
    """:func:`messages` of parsed lines: only these and the metas are ordered, by their narrow values."""
    which = "type = 'event_msg' and kind in (" + ", ".join(f"'{k}'" for k in TOLD) + ")"
    return rows(parsed, home, _message, which).where(f"not copied and {which}").select("path", "pos", "at", "session_id", "kind", "duration_ms", "start", "end", "item_id", "item_type")


def turns(told: DataFrame) -> DataFrame:
    """Completed turns of :func:`messages`: reported length, and model time as the length less the union of tool items.

    A start, an abort or a completion ends the turn before it, unless a later one was seen
    earlier in the file: then it is a replay, as is an item older than the latest of them. An
    item counts once a file, by its id, in the turn that is open where it stands. A turn
    without items has no model time; a completion without a length ends its turn and has no row.
    The union is a running maximum of ends by start, so a turn may have any number of items.
    """
    line = Window.partitionBy("path").orderBy("pos")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.col("kind").isin(*LIFECYCLE)
    rows = told.where("kind <> 'user_message'").withColumn("newest", F.max(F.when(marks, F.col("at"))).over(before))
    rows = rows.withColumn("ends", marks & (F.col("at").isNull() | F.col("newest").isNull() | (F.col("at") > F.col("newest"))))
    rows = rows.withColumn("turn", F.coalesce(F.count_if("ends").over(before), F.lit(0)))
    done = rows.where("ends and kind = 'task_complete' and duration_ms is not null").select("path", "turn", "pos", "at", "session_id", "duration_ms")
    items = rows.where("kind = 'item_completed' and start is not null and end is not null").where(F.coalesce(F.col("at") >= F.col("newest"), F.lit(True)))
    again = F.row_number().over(Window.partitionBy("path", "item_id").orderBy("pos"))
    named = items.where("item_id is not null").withColumn("nth", again).where("nth = 1").drop("nth")
    items = named.unionByName(items.where("item_id is null"))
    tool = ~F.coalesce(F.col("item_type").isin(*MODEL_ITEMS), F.lit(False)) & (F.col("end") > F.col("start"))
    spans = items.select("path", "turn", F.when(tool, F.col("start")).alias("start"), F.when(tool, F.col("end")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("path", "turn").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.col("end") - F.greatest("start", F.coalesce("reach", "start")), F.lit(0))
    busy = spans.withColumn("reach", reach).groupBy("path", "turn").agg(F.coalesce(F.sum(covered), F.lit(0)).alias("tool_ms"))
    out = done.join(busy, ["path", "turn"], "left").withColumn("model_ms", saturating_sub(F.col("duration_ms"), F.col("tool_ms")))
    return out.select("path", "pos", "at", "session_id", "duration_ms", F.lit(0).cast("long").alias("wait_ms"), F.when(F.col("tool_ms").isNotNull(), F.col("model_ms")).alias("model_ms"), F.lit("task_complete").alias("status"), F.lit(None).cast("string").alias("dedupe_key"))


def paces(told: DataFrame) -> DataFrame:
    """Of :func:`messages`, pauses from a completion to the next prompt, of 30 minutes at most; a completion pairs once.

    A completion that is not later than all before it in the file is a replay. A prompt that
    is not later than the pending completion, or too late, leaves it pending.
    """
    line = Window.partitionBy("path").orderBy("pos")
    rows = told.where("at is not null and kind in ('task_complete', 'user_message')").select("path", "pos", "at", "session_id", "kind")
    over = F.when(F.col("kind") == "task_complete", F.col("at"))
    rows = rows.withColumn("newest", F.max(over).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.unix_micros("at") - F.unix_micros("newest")
    prompts = rows.where("kind = 'user_message'").withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= ABSENCE))
    # between two later completions ``newest`` is the pending one
    first = prompts.withColumn("nth", F.row_number().over(Window.partitionBy("path", "newest").orderBy("pos"))).where("nth = 1")
    key = F.concat(F.lit("codex-pace:"), "session_id", F.lit(":"), F.unix_micros("at").cast("string"))
    return first.select("path", "pos", "at", "session_id", F.floor(F.col("gap") / 1000).alias("gap_ms"), key.alias("dedupe_key"))


def durations(decoded: DataFrame) -> DataFrame:
    """Completed turns with their reported length; aborted ones have none."""
    return turns(messages(decoded)).select("path", "pos", "at", "session_id", "duration_ms").where("duration_ms > 0")


def interrupts(decoded: DataFrame) -> DataFrame:
    """Turns that the user aborted; only those with a session and a turn id."""
    v = F.col("v")
    cut = decoded.where("not copied and type = 'event_msg' and session_id is not null").where((text_at(v, "$.payload.type") == "turn_aborted") & (text_at(v, "$.payload.reason") == "interrupted"))
    return cut.select("path", "pos", "at", F.concat(F.lit("codex-interrupt:v2:"), "session_id", F.lit(":"), text_at(v, "$.payload.turn_id")).alias("dedupe_key")).where("dedupe_key is not null")


def touches(decoded: DataFrame) -> DataFrame:
    return decoded.where("not copied and at is not null and session_id is not null").select("path", "pos", "at", "session_id")


def tool_events(decoded: DataFrame) -> DataFrame:
    """Tool calls; a shell wrapper's is named by the command that it runs."""
    v = F.col("v")
    calls = decoded.where("not copied and type = 'response_item'").select("path", "pos", "at", "session_id", "agent", "line_index", text_at(v, "$.payload.name").alias("name"), text_at(v, "$.payload.call_id").alias("call"), plain_text_at(v, "$.payload.arguments").alias("arguments"))
    inner = bounded_json(F.when(F.col("name").isin(*command.WRAPPERS), F.col("arguments")))
    calls = calls.where("name is not null").withColumn("tool_name", F.coalesce(command.command_name(inner), "name"))
    place = F.concat_ws(":", "path", F.col("line_index").cast("string"), "tool_name")
    kind = F.when(F.col("agent").isNull(), "main").otherwise("subagent")
    return calls.select("path", "pos", "at", "session_id", "tool_name", F.lit(None).cast("string").alias("subagent_type"), kind.alias("source_kind"), F.coalesce(F.concat(F.lit("tool:"), "call"), place).alias("dedupe_key"))


def _contexts(decoded: DataFrame, field: str, name: str, prefix: str) -> DataFrame:
    v = F.col("v")
    found = decoded.where("not copied and type = 'turn_context'").withColumn(name, text_at(v, f"$.payload.{field}")).where(F.col(name).isNotNull())
    turn = F.concat(F.lit(f"{prefix}:v2:"), "session_id", F.lit(":"), text_at(v, "$.payload.turn_id"))
    return found.select("path", "pos", "at", "session_id", name, F.coalesce(turn, _positional(prefix)).alias("dedupe_key"))


def efforts(decoded: DataFrame) -> DataFrame:
    return _contexts(decoded, "effort", "effort", "codex-effort")


def permissions(decoded: DataFrame) -> DataFrame:
    return _contexts(decoded, "approval_policy", "mode", "codex-permission")


def efforts_and_permissions(decoded: DataFrame) -> DataFrame:
    v = F.col("v")
    contexts = decoded.where("not copied and type = 'turn_context'")
    return contexts.select("path", "pos", "at", "session_id", text_at(v, "$.payload.effort").alias("effort"), text_at(v, "$.payload.approval_policy").alias("mode"))
