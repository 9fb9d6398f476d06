"""From the logs of all agents to one tagged event table, and from it the streams of every report.

``read(spark, roots, home, window)`` reads the folders of each agent and gives a stream that
stands in for the folder of a report::

    reports.turn_length(spark, streams.read(spark, {"codex": ["/logs/b"]}, "/home/me", window))

All events lie in one table: provider, kind, place, instant, key and the columns of all kinds.
Replayed records meet by one shuffle on provider, kind and key; the rule of each kind is an
order of its rows, so a single window and a single aggregate fold all kinds. The table is
written once, and each stream is a filter of it. A caller that reads only some kinds names
them; the others are then not decoded, and asking for one of them is an error.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.scalar import local_time
from meterlake.functions.tables import stored
from meterlake.operators import turns as turn_machine
from meterlake.plans.adapter import Stream
from meterlake.plans.adapter import Window as Dates
from meterlake.sources import agy, claude, codex, copilot, files, grok, opencode, text, updates

#: Columns of the kinds: usage, tool, touch, turn, limit, credit, effort, permission, interrupt, pace, mode.
COUNTERS = ("input", "output", "reasoning", "cache_read", "cache_creation", "w5m", "w1h", "volume")
METADATA = ("session_id", "model", "project", "source_kind", "agent", "skill")
COLUMNS = (
    {c: "string" for c in (*METADATA, "granularity", "tool_name", "subagent_type", "status", "effort", "mode")} | {c: "long" for c in (*COUNTERS, "duration_ms", "wait_ms", "model_ms", "gap_ms", "nano_aiu")}
    | {"used_percent": "double", "has_thinking": "boolean", "fast": "boolean", "server_tools": "map<string,bigint>"}
)
ZERO = {*COUNTERS, "wait_ms"}
RANK = "struct<fork:int,depth:int>"
PLACE = "struct<block:bigint,n:bigint>"


def tagged(events: DataFrame, provider: str, kind: str, only: Iterable[str] = COLUMNS) -> DataFrame:
    """The columns of the event table, or ``only`` those; an agent's missing counters are 0 and its missing facts null."""
    place = {"path": "string", "pos": PLACE, "rank": RANK, "at": "timestamp", "dedupe_key": "string"}
    given = set(events.columns)
    stand = {"rank": F.struct(F.lit(0).alias("fork"), F.lit(0).alias("depth")), "source_kind": F.lit("main")} | {c: F.lit(0) for c in ZERO}
    kinds = place | {c: t for c, t in COLUMNS.items() if c in only}
    columns = [F.col(c).cast(t).alias(c) if c in given else stand.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return events.select(F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), *columns)


def merged(events: DataFrame) -> DataFrame:
    """One row for each provider, kind and key; rows without a key stay as they are.

    Usage: rows larger than all before them come first, newest to oldest, then the others; the
    counters are the first row's, each fact the first that is known. Turns: the longest row,
    the first of equals. Modes: flags of any row. All others: the first row. The time is the
    earliest of the key; of a turn the earliest among its longest rows; of a pace the first row's.
    """
    return _folded(events).unionByName(events.where("dedupe_key is null"))


def _folded(events: DataFrame) -> DataFrame:
    """The rows with a key of :func:`merged`; columns of the kinds that the table has not are left out."""
    key = ["provider", "kind", "dedupe_key"]
    has = [c for c in COLUMNS if c in events.columns]
    events = events.withColumns({c: F.lit(0).cast("long") for c in ("volume", "duration_ms") if c not in has})
    keyed = events.where("dedupe_key is not null")
    arrival = Window.partitionBy(*key).orderBy("rank", "path", "pos")
    rows = keyed.withColumn("n", F.row_number().over(arrival)).withColumn("most", F.max("volume").over(arrival.rowsBetween(Window.unboundedPreceding, -1)))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    record = F.col("volume") > F.coalesce("most", F.lit(-1))
    first = F.when(is_("usage"), F.when(record, 0).otherwise(1)).when(is_("turn"), -F.coalesce("duration_ms", F.lit(0))).otherwise(0).cast("long")
    rows = rows.withColumn("line", F.struct(first.alias("a"), F.when(is_("usage") & record, -F.col("n")).otherwise(F.col("n")).alias("b")))
    fact = lambda c: F.min_by(c, F.when(~is_("usage") | F.col(c).isNotNull(), F.col("line")))
    # the columns of the first row together, so that rows are compared once for all of them
    plain = [c for c in has if c not in (*METADATA, "has_thinking", "fast")]
    found = {c: fact(c) for c in METADATA if c in has} | {c: F.when(F.first("kind") == "mode", F.bool_or(c)) for c in ("has_thinking", "fast") if c in has}
    times = F.when(F.first("kind") == "pace", F.min_by("at", "line")).when(F.first("kind") == "turn", F.min_by("longest_at", F.struct("first", F.col("longest_at").isNull(), "longest_at"))).otherwise(F.min("at"))
    rows = rows.withColumn("longest_at", F.col("at")).withColumn("first", F.col("line.a"))
    folded = rows.groupBy(*key).agg(F.min_by(F.struct("path", "pos", "rank"), "n").alias("place"), F.min_by(F.struct(F.lit(0).alias("any"), *plain), "line").alias("x"), times.alias("at"), *[x.alias(c) for c, x in found.items()])
    return folded.select("*", "place.*", "x.*").select(*key, "path", "pos", "rank", "at", *has)


def of_people(lines: DataFrame) -> DataFrame:
    """Without the folders of observers."""
    return lines.where(~F.col("path").rlike(f"[^/]*{NOISE}[^/]*/"))


#: Events of each kind, decoded when they are asked for.
Kinds = dict[str, Callable[[], DataFrame]]


def _claude(lines: DataFrame, home: str) -> Kinds:
    """Sessions of observers, which run always, are no one's activity."""
    rows = cache(lambda: stored(claude.rows(text.parse(of_people(lines)), home)))
    found = cache(lambda: stored(turn_machine.turns(claude.turn_rows(rows()))))
    return {
        "usage": lambda: claude.usage_events(rows()), "tool": lambda: claude.tool_events(rows()), "touch": lambda: claude.touches(rows()), "mode": lambda: claude.mode_events(rows()), "effort": lambda: claude.effort_events(rows()),
        "permission": lambda: claude.permission_events(rows()), "interrupt": lambda: claude.interrupt_events(rows()), "turn": lambda: turn_machine.durations(found()), "pace": lambda: turn_machine.paces(found()),
    }


# Fixed value: what the folders of observers have in their names.
NOISE = "claude-mem-observer"


def _codex(lines: DataFrame, home: str) -> Kinds:
    rows = cache(lambda: stored(codex.rows(text.parse(lines), home)))
    told = cache(lambda: stored(codex.told(text.parse(lines), home)))
    return {
        "usage": lambda: codex.usage_events(rows()), "tool": lambda: codex.tool_events(rows()), "touch": lambda: codex.touches(rows()), "turn": lambda: codex.turns(told()), "pace": lambda: codex.paces(told()),
        "limit": lambda: codex.rate_limits(rows()), "effort": lambda: codex.efforts(rows()), "permission": lambda: codex.permissions(rows()), "interrupt": lambda: codex.interrupts(rows()),
    }


def _grok(lines: DataFrame, summaries: DataFrame | None, home: str) -> Kinds:
    @cache
    def rows() -> DataFrame:
        told = lines.sparkSession.createDataFrame([], "path string, text string") if summaries is None else summaries
        known = stored(grok.sessions(lines.select("path").distinct(), told, home))
        return stored(grok.rows(text.parse(lines), known))

    return {"usage": lambda: grok.usage_events(rows()), "tool": lambda: grok.tool_events(rows()), "touch": lambda: grok.touches(rows()), "turn": lambda: grok.durations(rows())}


def _made(kinds: dict[str, DataFrame]) -> Kinds:
    return {kind: lambda e=events: e for kind, events in kinds.items()}


def _copilot(lines: DataFrame, stores: list[str], home: str) -> Kinds:
    rows = stored(updates.copilot_rows(text.parse(lines)))
    usage = stored(updates.copilot_usage(rows).withColumns({"project": F.lit(None).cast("string"), "source_kind": F.lit("main")}))
    touches = rows.where("at is not null and session_id is not null").select("path", "pos", "at", "session_id")
    if stores:
        book = copilot.ledger(*[stored(t) for t in copilot.read_ledger(lines.sparkSession, stores)], home)
        kept, calls = copilot.reconcile(usage, book)
        usage, touches = kept.unionByName(calls, allowMissingColumns=True), touches.unionByName(book.touches, allowMissingColumns=True)
    return _made({"usage": usage, "tool": updates.copilot_tools(rows), "touch": touches, "turn": updates.copilot_turns(rows), "credit": updates.copilot_credits(rows)})


def _opencode(spark: SparkSession, stores: list[str], home: str) -> Kinds:
    tables = opencode.Tables(*[stored(t) for t in opencode.read_tables(spark, stores)])
    told = stored(opencode.messages(tables, home))
    return _made({"usage": opencode.usage_events(told), "tool": opencode.tool_events(tables, told), "touch": opencode.touches(told), "turn": opencode.durations(told)})


def _agy(spark: SparkSession, roots: list[list[str]], history: DataFrame | None, logs: DataFrame | None, home: str, offset_seconds: int) -> Kinds:
    made: dict[str, DataFrame] = {}
    touch = []
    if any(roots):
        told = agy.Conversations(*[stored(t) for t in agy.read_conversations(spark, roots)])
        made["usage"] = stored(agy.usage_events(told, home, stored(agy.generations(told))))
        touch.append(agy.touches(made["usage"]))
    if history is not None:
        touch.append(agy.history_touches(stored(history)).select("at", "session_id"))
    if logs is not None:
        rows = stored(agy.log_rows(logs, offset_seconds))
        made["tool"] = agy.log_tools(rows)
        touch.append(rows.select("at", "session_id"))
    for t in touch:
        made["touch"] = made["touch"].union(t) if "touch" in made else t
    return _made(made)


LINES: dict[str, Callable[[DataFrame, str], Kinds]] = {
    "claude": _claude, "codex": _codex, "grok": lambda lines, home: _grok(lines, None, home), "copilot": lambda lines, home: _copilot(lines, [], home),
}


def event_table(parts: dict[str, Kinds], kinds: Iterable[str] | None = None) -> DataFrame:
    """The written table of the merged events of ``{provider: {kind: events}}``, of ``kinds`` or all.

    Columns that no event gives are left out until the end, where they are constant. Rows
    without a key meet no others, so they are written once.
    """
    wanted = [(provider, kind, made()) for provider, own in parts.items() for kind, made in own.items() if kinds is None or kind in kinds]
    given = {c for _, _, events in wanted for c in events.columns}
    every = None
    for provider, kind, events in wanted:
        one = tagged(events, provider, kind, given)
        every = one if every is None else every.unionByName(one)
    every = stored(every)
    whole = stored(_folded(every)).unionByName(every.where("dedupe_key is null"))
    absent = {c: F.lit("main" if c == "source_kind" else 0 if c in ZERO else None).cast(t) for c, t in COLUMNS.items() if c not in every.columns}
    return whole.withColumns(absent).select("provider", "kind", "path", "pos", "rank", "at", "dedupe_key", *COLUMNS)


def from_lines(lines: dict[str, DataFrame], home: str, window: Dates, offset_seconds: int = 0, kinds: Iterable[str] | None = None) -> Stream:
    """A stream from path, pos and line of each agent with line logs; of ``kinds`` alone if they are named."""
    return stream(event_table({p: LINES[p](rows, home) for p, rows in lines.items()}, kinds), window, offset_seconds, kinds)


def stream(events: DataFrame, window: Dates, offset_seconds: int = 0, kinds: Iterable[str] | None = None) -> Stream:
    """The table with local, zone-free times; ``ordinal`` numbers the events in the order of their places."""
    local = events.withColumn("at", local_time(F.col("at"), offset_seconds)).withColumns({"d": F.to_date("at"), "h": F.hour("at")})
    local = local.withColumn("ordinal", F.struct("rank", "path", "pos", F.xxhash64("dedupe_key").alias("key")))
    usage = local.where("kind = 'usage'") if kinds is None or "usage" in kinds else None
    return Stream(usage, window, local, None if kinds is None else frozenset(kinds))


def _files(folders: list[str], *patterns: str) -> list[str]:
    return sorted(p for folder in folders for pattern in patterns for p in glob.glob(os.path.join(folder, pattern)))


def rollout_lines(spark: SparkSession, folders: list[str], tolerant: bool = False) -> DataFrame:
    """Lines of one physical file for each rollout of the folders and their archives."""
    roots = files.with_archives(spark, folders)
    return files.without(text.read_lines(spark, roots, "*.jsonl*", tolerant=tolerant), files.second_copies(files.listed(spark, roots, "*.jsonl*")))


def line_files(spark: SparkSession, provider: str, folders: list[str], tolerant: bool = False) -> DataFrame | None:
    """path, pos and line of an agent's line logs, or nothing if it keeps only stores."""
    if provider == "codex":
        return rollout_lines(spark, folders, tolerant)
    if provider == "agy":
        folders = _files(folders, "antigravity-cli/history.jsonl", "antigravity-cli/log/*.log")
    return text.read_lines(spark, folders, PATTERNS[provider], tolerant=tolerant) if provider in PATTERNS and folders else None


# Names of the line logs.
PATTERNS = {"claude": "*.jsonl", "grok": "updates.jsonl", "copilot": "events.jsonl", "agy": "*"}


def read(spark: SparkSession, roots: dict[str, list[str]], home: str, window: Dates, offset_seconds: int = 0, tolerant: bool = False) -> Stream:
    """The stream of all agents' folders; SQLite stores in them are found by their usual places.

    ``tolerant``: a line log that can't be read to its end counts as far as it was read.
    """
    parts: dict[str, Kinds] = {}
    for provider, folders in roots.items():
        if provider in ("claude", "codex"):
            parts[provider] = LINES[provider](line_files(spark, provider, folders, tolerant), home)
        elif provider == "grok":
            parts[provider] = _grok(line_files(spark, provider, folders, tolerant), grok.read_summaries(spark, folders), home)
        elif provider == "copilot":
            parts[provider] = _copilot(line_files(spark, provider, folders, tolerant), _files(folders, "session-store.db"), home)
        elif provider == "opencode":
            parts[provider] = _opencode(spark, _files(folders, "opencode*.db"), home)
        elif provider == "agy":
            stores = [_files(folders, f"{app}/conversations/*.db") for app in ("antigravity-cli", "antigravity")]
            history, logs = _files(folders, "antigravity-cli/history.jsonl"), _files(folders, "antigravity-cli/log/*.log")
            parts[provider] = _agy(spark, stores, text.read_lines(spark, history, "*") if history else None, text.read_lines(spark, logs, "*") if logs else None, home, offset_seconds)
        else:
            raise ValueError(f"no agent is named {provider}")
    return stream(event_table(parts), window, offset_seconds)


def scan_summary(spark: SparkSession, roots: dict[str, list[str]], events: DataFrame) -> DataFrame:
    """What the scan of each agent's line logs saw, and last the sum, whose provider is null.

    files, lines, parse_errors (lines that are overlong or no JSON, and read errors, which end
    a file), unreadable_files, then the usage, tool and turn events of the merged table.
    Stores tell their own losses (``scan_stats`` of their decoders). Log texts are no JSON and
    have no errors but those of reading.
    """
    kinds = ("usage", "tool", "turn")
    every = events.groupBy("provider").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_events") for k in kinds])
    seen = None
    for provider, folders in roots.items():
        lines = line_files(spark, provider, folders, tolerant=True)
        if lines is None:
            continue
        lines = of_people(lines) if provider == "claude" else lines
        if provider == "codex":
            found = files.listed(spark, files.with_archives(spark, folders), "*.jsonl*")
            found = found.join(files.second_copies(found), "path", "left_anti")
        else:
            found = files.listed(spark, folders, PATTERNS[provider]) if provider != "agy" else files.listed(spark, _files(folders, "antigravity-cli/history.jsonl", "antigravity-cli/log/*.log"), "*")
            found = of_people(found) if provider == "claude" else found
        read_well = F.col("v").isNotNull() | ~F.col("path").endswith(".jsonl") & ~F.col("path").endswith(".zst")
        good = text.parse(lines).where(F.trim("line") != "").where(read_well).agg(F.count("*").alias("good"))
        told = files.census(found).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("blank").alias("blank"), F.count("problem").alias("unreadable_files"))
        both = told.unionByName(good, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "lines", "blank", "unreadable_files", "good")])
        errors = F.col("lines") - F.col("blank") + F.col("unreadable_files") - F.col("good")
        one = both.select(F.lit(provider).alias("provider"), "files", "lines", errors.alias("parse_errors"), "unreadable_files")
        seen = one if seen is None else seen.union(one)
    none = F.lit(0).cast("long")
    alone = every.select("provider", *[none.alias(c) for c in ("files", "lines", "parse_errors", "unreadable_files")], *[f"{k}_events" for k in kinds])
    both = alone if seen is None else alone.union(seen.select("*", *[none.alias(f"{k}_events") for k in kinds]))
    sums = [F.sum(c).cast("long").alias(c) for c in both.columns[1:]]
    return both.rollup("provider").agg(*sums)
