"""Queries over logs: the driver's tables written as agents' log lines, then decoded.

Events of the first provider become transcripts (a partial and a final line for each
message), those of the second rollouts with echoes, the others turn updates or session
snapshots; conversations become transcripts with turns. The twins state the same results
from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import dedupe, sequence, turns
from meterlake.plans import reports
from meterlake.plans.adapter import WINDOW, Stream, in_window, read, usage_events
from meterlake.plans.ingest import dated, shared_folder, stored, united
from meterlake.sources import claude, codex, text

HOME = "/home/me"


def _at(instant: Column) -> Column:
    return F.concat(F.translate(instant.cast("string"), " ", "T"), F.lit("Z"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _place(n: Column) -> Column:
    return F.struct(F.lit(0).cast("long").alias("block"), n.cast("long").alias("n"))


def _lines(path: Column, n: Column, body: Column) -> list[Column]:
    return [path.alias("path"), _place(n).alias("pos"), F.to_json(body).alias("line")]


def _of(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return usage_events(spark, sf_dir).where(which)


def _named(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines a message: the partial one knows the model, the final one the counters."""
    # a few megabytes of events make many of lines, so they are dealt out evenly first
    e = _of(spark, sf_dir, "provider = 'claude'").repartition("ordinal")
    i, k, user = F.col("ordinal"), F.col("k"), F.col("user_id")
    path = _text("/logs/projects/-home-me-", F.translate("project", "/", "-"), "/", F.col("session_id"), ".jsonl")
    cwd = F.when(user % 2 == 0, _text(HOME + "/", F.col("project")))
    common = {"type": "assistant", "sessionId": F.col("session_id"), "cwd": cwd, "isSidechain": F.col("source_kind") == "subagent"}
    first = _named(**common, uuid=_text("a", i), timestamp=_at(F.col("at")), message=_named(id=_text("m", i), model=F.col("model"), usage=_named(input_tokens=F.col("input"))))
    step = F.when(i % 17 == 0, F.array(_named(type="advisor_message", model="claude-fable-5", input_tokens=k, output_tokens=2)))
    usage = _named(
        input_tokens=F.col("input"), output_tokens=F.col("output"), cache_creation_input_tokens=F.col("cache_creation"), cache_read_input_tokens=F.col("cache_read"),
        cache_creation=_named(ephemeral_1h_input_tokens=F.col("w1h"), ephemeral_5m_input_tokens=F.col("w5m")), speed=F.when(k % 3 == 0, "fast"), iterations=step,
    )
    tool = _named(type="tool_use", id=_text("t", user, "-", k), name=F.col("tool_name"), input=_named(subagent_type=F.col("agent")))
    none = F.lit(None).cast("string")
    thought = _named(type=F.when(k % 2 == 0, "thinking").otherwise("text"), id=none, name=none, input=_named(subagent_type=none))
    message = _named(id=_text("m", i), model=F.when(i % 4 != 0, F.col("model")), usage=usage, content=F.array(tool, thought))
    later = F.timestamp_add("SECOND", F.lit(1), F.col("at"))
    last = _named(**common, uuid=_text("b", i), timestamp=_at(later), attributionAgent=F.col("agent"), attributionSkill=F.col("skill"), effort=F.when(k % 5 == 0, "high"), message=message)
    return e.select(*_lines(path, i * 2, first)).union(e.select(*_lines(path, i * 2 + 1, last)))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meta for each file; even events report a record and its echo, odd ones a count alone."""
    e = _of(spark, sf_dir, "provider = 'codex'")
    i = F.col("ordinal")
    path = _text("/logs/sessions/", F.col("session_id"), ".jsonl")
    at = _at(F.col("at"))
    head = e.groupBy("session_id", "project").agg(F.min("at").alias("at"))
    meta = head.select(*_lines(path, F.lit(-1), _named(timestamp=at, type="session_meta", payload=_named(id=F.col("session_id"), cwd=_text(HOME + "/", F.col("project"))))))
    whole = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    usage = _named(input_tokens=whole, cached_input_tokens=F.col("cache_read"), cache_write_input_tokens=F.col("cache_creation"), output_tokens=F.col("output"), total_tokens=whole + F.col("output"))
    context = _named(timestamp=at, type="turn_context", payload=_named(model=F.col("model"), effort="low", approval_policy="never"))
    record = _named(timestamp=at, type="token_usage_record", payload=_named(thread_id=F.col("session_id"), response_id=_text("r", i), usage=usage))
    info = _named(last_token_usage=usage, total_token_usage=_named(total_tokens=i + 1))
    count = _named(timestamp=at, type="event_msg", payload=_named(type="token_count", info=info, rate_limits=_named(primary=_named(used_percent=F.col("k") + 20))))
    done = _named(timestamp=at, type="event_msg", payload=_named(type="task_complete", duration_ms=F.col("duration_ms")))
    parts = [e.select(*_lines(path, i * 4, context)), e.where("ordinal % 2 = 0").select(*_lines(path, i * 4 + 1, record)), e.select(*_lines(path, i * 4 + 2, count)), e.select(*_lines(path, i * 4 + 3, done))]
    for part in parts:
        meta = meta.union(part)
    return meta


def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed turns with the usage of one model."""
    # dealt out evenly first, as transcripts are
    e = _of(spark, sf_dir, "provider = 'opencode' and user_id % 2 = 0").repartition("ordinal")
    counts = _named(inputTokens=F.col("input") + F.col("cache_read") + F.col("cache_creation"), cachedReadTokens=F.col("cache_read"), cacheCreationTokens=F.col("cache_creation"), outputTokens=F.col("output"))
    usage = _named(apiDurationMs=F.col("duration_ms"), modelUsage=F.create_map("model", counts))
    update = _named(sessionUpdate="turn_completed", prompt_id=_text("p", F.col("ordinal")), usage=usage)
    seconds = F.floor(F.unix_micros(F.to_timestamp(_at(F.col("at")))) / 1_000_000)
    return e.select(*_lines(_text("/logs/g/", F.col("session_id"), "/updates.jsonl"), F.col("ordinal"), _named(timestamp=seconds, params=_named(update=update))))


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by session and model that start again every 1,000 events."""
    e = _of(spark, sf_dir, "provider = 'opencode' and user_id % 2 = 1")
    upto = Window.partitionBy("session_id", "model", F.floor(F.col("ordinal") / 1000)).orderBy("ordinal")
    total = lambda c: F.sum(c).over(upto)
    whole = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    usage = _named(inputTokens=total(whole), outputTokens=total("output"), cacheReadTokens=total("cache_read"), cacheWriteTokens=total("cache_creation"))
    data = _named(modelMetrics=F.create_map("model", _named(usage=usage)))
    body = _named(id=_text("c", F.col("ordinal")), timestamp=_at(F.col("at")), type="session.shutdown", data=data)
    return e.select(*_lines(_text("/logs/session-state/", F.col("session_id"), "/events.jsonl"), F.col("ordinal"), body))


def dialogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a turn every seven minutes."""
    c = read(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-03-01").cast("date"), F.col("conv_id").cast("int"))
    at = F.concat(day.cast("string"), F.format_string("T00:%02d:00Z", F.col("turn") * 7))
    body = _named(type=F.col("role"), uuid=_text(F.col("conv_id"), "-", F.col("turn")), timestamp=at, sessionId=_text("c", F.col("conv_id")), message=_named(content=F.col("text")))
    return c.select(*_lines(_text("/logs/projects/-x/", F.col("conv_id"), ".jsonl"), F.col("turn"), body))


def _transcripts(spark, sf_dir):
    return claude.rows(text.parse(stored(transcript_lines(spark, sf_dir))), HOME)


def _all(spark, sf_dir) -> DataFrame:
    lines = {"claude": transcript_lines, "codex": rollout_lines, "grok": update_lines, "copilot": snapshot_lines}
    return united({p: stored(made(spark, sf_dir)) for p, made in lines.items()}, HOME)


def _shown(usage: DataFrame) -> DataFrame:
    names = ("provider", "dedupe_key", "session_id", "model", "project", "source_kind", "granularity", "agent", "skill", "input", "output", "cache_read", "cache_creation", "w5m", "w1h", "volume")
    return usage.select(F.unix_micros("at").alias("at_us"), *names)


def log_transcript_usage(spark, sf_dir):
    """Messages and advisor steps of transcripts, partial lines merged."""
    return _shown(united({"claude": stored(transcript_lines(spark, sf_dir))}, HOME))


def log_transcript_tools(spark, sf_dir):
    """Tool calls; of a repeated call id the first, at its earliest time."""
    calls = claude.tool_events(_transcripts(spark, sf_dir))
    first = dedupe.keep_first(calls, ["dedupe_key"], ["path", "pos"], "at", ["session_id", "tool_name", "subagent_type"])
    return first.select("dedupe_key", F.unix_micros("at").alias("at_us"), "session_id", "tool_name", "subagent_type")


def log_transcript_modes(spark, sf_dir):
    """Thinking and fast messages: true if any of a message's lines says so."""
    modes = dedupe.merge_flags(claude.mode_events(_transcripts(spark, sf_dir)), ["dedupe_key"], "at", ["has_thinking", "fast"])
    return modes.select("dedupe_key", F.unix_micros("at").alias("at_us"), "has_thinking", "fast")


def log_transcript_efforts(spark, sf_dir):
    return claude.effort_events(_transcripts(spark, sf_dir)).select("dedupe_key", "effort")


def log_transcript_touches(spark, sf_dir):
    """First and last touch of each session."""
    seen = claude.touches(_transcripts(spark, sf_dir)).groupBy("session_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("touches"))
    return seen.select("session_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "touches")


def log_dialogue_turns(spark, sf_dir):
    """Turns of transcripts: from a prompt to the last row before the next."""
    found = turns.turns(claude.turn_rows(claude.rows(text.parse(stored(dialogue_lines(spark, sf_dir))), HOME)))
    return turns.durations(found).select("dedupe_key", "session_id", F.unix_micros("at").alias("end_us"), "duration_ms", "wait_ms", "model_ms", "status")


def log_dialogue_paces(spark, sf_dir):
    """Pauses between the end of a turn and the next prompt."""
    found = turns.turns(claude.turn_rows(claude.rows(text.parse(stored(dialogue_lines(spark, sf_dir))), HOME)))
    return turns.paces(found).select("dedupe_key", F.unix_micros("at").alias("at_us"), "gap_ms")


def log_rollout_usage(spark, sf_dir):
    """Usage records, and token counts that echo none."""
    return _shown(united({"codex": stored(rollout_lines(spark, sf_dir))}, HOME))


def _rollouts(spark, sf_dir):
    return codex.rows(text.parse(stored(rollout_lines(spark, sf_dir))), HOME)


def log_rollout_limits(spark, sf_dir):
    return codex.rate_limits(_rollouts(spark, sf_dir)).select("session_id", F.unix_micros("at").alias("at_us"), "used_percent")


def log_rollout_durations(spark, sf_dir):
    return codex.durations(_rollouts(spark, sf_dir)).select("session_id", F.unix_micros("at").alias("at_us"), "duration_ms")


def log_update_usage(spark, sf_dir):
    """Usage of completed turns by model."""
    return _shown(united({"grok": stored(update_lines(spark, sf_dir))}, HOME))


def log_snapshot_usage(spark, sf_dir):
    """Cumulative snapshots as differences."""
    return _shown(united({"copilot": stored(snapshot_lines(spark, sf_dir))}, HOME))


def _stream(spark, sf_dir) -> Stream:
    return Stream(dated(_all(spark, sf_dir)), WINDOW)


def log_daily_usage(spark, sf_dir):
    """The daily report over the decoded logs of all agents."""
    return reports.daily_usage(spark, _stream(spark, sf_dir))


def log_model_stats(spark, sf_dir):
    """Priced models over the decoded logs of all agents."""
    return reports.model_stats(spark, _stream(spark, sf_dir))


def log_session_bounds(spark, sf_dir):
    """First and last usage of each session and day; the stream has usage alone, whose calls are its touches."""
    return sequence.session_days(in_window(_stream(spark, sf_dir).usage, WINDOW))


def log_file_scan(spark, sf_dir):
    """Lines written as files, one for each session, and read back: files, lines, unreadable lines."""
    lines = transcript_lines(spark, sf_dir)
    broken = F.when(F.col("pos.n") % 13 == 0, F.concat(F.lit("{"), F.col("line"))).otherwise(F.col("line"))
    folder = shared_folder(spark)
    lines.select(F.col("path").alias("file"), broken.alias("line")).repartition("file").write.partitionBy("file").text(folder)
    return text.scan_stats(text.parse(text.read_lines(spark, [folder], "*.txt")))
