"""Decoders of the last agent: conversation stores with binary rows, its history and its text logs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.command import SPACE
from meterlake.functions.scalar import ID_BYTES, PATH_BYTES, bounded, from_millis, from_seconds, plausible, project_from_cwd
from meterlake.sources import wire
from meterlake.sources.sqlite import place, read_store
from meterlake.sources.text import parse, text_at

# How a row's time was found, weakest first.
FILE_TIME, CONVERSATION, STEP, ROW = range(4)
MOST = np.uint64((1 << 63) - 1)
# Fixed value: lines of a history that are numbered together, 65,536 places.
BLOCK_BITS = 16
GENERATION = "store string, idx long, has_usage boolean, system long, fresh long, total long, has_total boolean, cache_read long, output_text long, thinking long, response_id string, row_ms long, display string, served string, selected string"


def _count(value: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.minimum(value[0], MOST)


def _millis(stamp: wire.Spans) -> tuple[np.ndarray, np.ndarray]:
    """Milliseconds of a seconds and nanoseconds message, and whether it has any in 64 bits."""
    got, _ = wire.fields(stamp, (1, 2))
    seconds, nanos = got[1][0], got[2][0]
    fine = stamp.known & got[1][1] & (seconds <= np.uint64(9_000_000_000_000_000)) & (nanos <= MOST)
    seconds = np.where(fine, seconds, 0).astype(np.int64)
    return seconds * 1000 + np.where(fine, nanos, 0).astype(np.int64) // 1_000_000, fine


def _masked(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64), mask=~known)


def _generations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, top = wire.fields(wire.spans(batch.column(2)), (), (1, 3))
        _, chat = wire.fields(top[1], (), (4, 9, 19, 21))
        usage, (_, ids) = wire.fields(chat[4], (1, 2, 3, 5, 9, 10))[0], wire.fields(chat[4], (), (11,))
        _, clock = wire.fields(chat[9], (), (4,))
        _, config = wire.fields(top[3], (), (28,))
        ms, dated = _millis(clock[4])
        longs = [pa.array(_count(usage[f]).astype(np.int64)) for f in (1, 2, 3, 5, 9, 10)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(chat[4].known), *longs[:3], pa.array(usage[3][1]), *longs[3:], wire.texts(ids[11], ID_BYTES), _masked(ms, dated), wire.texts(chat[21], ID_BYTES), wire.texts(chat[19], ID_BYTES), wire.texts(config[28], ID_BYTES)],
            [x.split()[0] for x in GENERATION.split(", ")],
        )


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, top = wire.fields(wire.spans(batch.column(2)), (), (1, 9))
        _, usage = wire.fields(top[9], (), (11,))
        ms, dated = _millis(top[1])
        yield pa.record_batch([batch.column(0), batch.column(1), wire.texts(usage[11], ID_BYTES), _masked(ms, dated)], ["store", "idx", "response_id", "ms"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, top = wire.fields(wire.spans(batch.column(2)), (), (1, 2))
        _, folder = wire.fields(top[1], (), (1,))
        ms, dated = _millis(top[2])
        yield pa.record_batch([batch.column(0), batch.column(1), wire.texts(folder[1], PATH_BYTES + 16), _masked(ms, dated)], ["store", "pos", "uri", "ms"])


class Conversations(NamedTuple):
    """Rows of the stores' tables as :func:`read_store` gives them, and (store, root, mtime_ms)."""

    generations: DataFrame
    steps: DataFrame
    heads: DataFrame
    files: DataFrame


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        newest = [max((int(os.stat(p + s).st_mtime * 1000) for s in ("", "-wal", "-shm") if os.path.exists(p + s)), default=0) for p in batch.column(0).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(newest, pa.int64())], ["store", "root", "mtime_ms"])


def read_conversations(spark: SparkSession, roots: list[list[str]]) -> Conversations:
    """The stores of each root, first root first."""
    paths = [p for stores in roots for p in stores]
    files = spark.createDataFrame([(p, n) for n, stores in enumerate(roots) for p in stores], "store string, root int").mapInArrow(_times, "store string, root int, mtime_ms long")
    return Conversations(
        read_store(spark, paths, "gen_metadata", "idx long, data binary"), read_store(spark, paths, "steps", "idx long, metadata binary"), read_store(spark, paths, "trajectory_metadata_blob", "data binary"), files
    )


def _dated(ms: Column) -> Column:
    """Milliseconds after 1970 in the plausible range, else null."""
    return F.when((ms > 0) & from_millis(ms).isNotNull(), ms)


def _filled(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def generations(told: Conversations) -> DataFrame:
    """Every row's wire fields; rows whose total contradicts its parts are ``drift``."""
    rows = told.generations.where("problem is null and idx is not null and data is not null").select("store", "idx", "data")
    out = rows.mapInArrow(_generations, GENERATION)
    whole = F.col("output_text").cast("decimal(20,0)") + F.col("thinking")
    empty = (F.col("system") == 0) & (F.col("fresh") == 0) & (F.col("output_text") == 0) & (F.col("thinking") == 0) & (F.col("cache_read") == 0)
    state = F.when(~F.col("has_usage") | ~F.col("has_total"), "empty").when(F.col("total") != whole, "drift").when(empty, "empty").otherwise("event")
    return out.withColumn("state", state)


def usage_events(told: Conversations, home: str, decoded: DataFrame | None = None) -> DataFrame:
    """One event for each generation over all stores: the copy with the strongest evidence of its time.

    A row's time is its own stamp, else its step's, found by response id (the first step of an
    id counts), else the conversation's, else the file's. A window applies only afterwards.
    """
    rows = decoded if decoded is not None else generations(told)
    steps = told.steps.where("problem is null and metadata is not null").select("store", "idx", "metadata").mapInArrow(_steps, "store string, idx long, response_id string, ms long")
    steps = steps.withColumn("response_id", _filled("response_id")).withColumn("ms", _dated(F.col("ms"))).where("response_id is not null and ms is not null").groupBy("store", "response_id").agg(F.min_by("ms", "idx").alias("step_ms"))
    heads = told.heads.where("problem is null and data is not null and pos = 0").select("store", "pos", "data").mapInArrow(_heads, "store string, pos long, uri string, ms long")
    path = F.regexp_replace("uri", "^(file://)+", "")
    folder = F.when(path.rlike("^/[A-Za-z]:"), F.expr("substr(regexp_replace(uri, '^(file://)+', ''), 2)")).otherwise(path)
    heads = heads.select("store", project_from_cwd(bounded(folder, PATH_BYTES), home).alias("project"), _dated(F.col("ms")).alias("start_ms"))
    parent = lambda c: F.when(F.col(c).contains("-"), F.regexp_extract(c, "^(.*)-[^-]*$", 1))
    bases = rows.withColumn("selected", _filled("selected")).where("selected is not null").select("store", parent("selected").alias("base")).where("base is not null").distinct()
    used = rows.where("state = 'event'").withColumns({"response_id": _filled("response_id"), "display": _filled("display"), "served": _filled("served")}).withColumn("above", parent("served"))
    mark = F.lit(True)
    used = used.join(bases.select("store", F.col("base").alias("served"), mark.alias("is_base")), ["store", "served"], "left").join(bases.select("store", F.col("base").alias("above"), mark.alias("above_base")), ["store", "above"], "left")
    model = F.coalesce("display", F.when(F.col("is_base").isNull() & F.col("above_base"), F.col("above")).otherwise(F.col("served")))
    used = used.join(steps, ["store", "response_id"], "left").join(heads, "store", "left").join(told.files, "store", "left")
    used = used.withColumn("row_ms", _dated(F.col("row_ms")))
    source = F.when(F.col("row_ms").isNotNull(), ROW).when(F.col("step_ms").isNotNull(), STEP).when(F.col("start_ms").isNotNull(), CONVERSATION).otherwise(FILE_TIME)
    session = F.regexp_replace(F.substring_index("store", "/", -1), r"\.[^.]*$", "")
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    sum_ = lambda a, b: F.least(F.col(a).cast("decimal(20,0)") + F.col(b), most).cast("long")
    out = used.select(
        F.col("store").alias("path"), place(F.col("idx")).alias("pos"), "root", source.alias("evidence"), from_millis(F.coalesce("row_ms", "step_ms", "start_ms", "mtime_ms")).alias("at"), session.alias("session_id"), model.alias("model"), "project",
        F.coalesce(F.col("response_id"), F.concat(session, F.lit("#"), F.col("idx").cast("string"))).alias("dedupe_key"), sum_("system", "fresh").alias("input"), sum_("output_text", "thinking").alias("output"), F.col("thinking").alias("reasoning"), "cache_read",
        F.lit(0).cast("long").alias("cache_creation"), F.lit("call").alias("granularity"), F.lit("main").alias("source_kind"),
    )
    out = out.withColumn("volume", F.least(F.col("input").cast("decimal(20,0)") + F.col("output") + F.col("cache_read"), most).cast("long"))
    order = F.struct(-F.col("evidence"), F.col("root"), F.col("path"), F.col("pos"))
    return out.groupBy("dedupe_key").agg(F.min_by(F.struct(*[c for c in out.columns if c != "dedupe_key"]), order).alias("x")).select("dedupe_key", "x.*").drop("root")


def touches(usage: DataFrame) -> DataFrame:
    return usage.where("at is not null").select("at", "session_id")


def scan_stats(told: Conversations, decoded: DataFrame | None = None) -> DataFrame:
    """Rows of generations, those that drifted from the known format, and stores that were cut."""
    rows = decoded if decoded is not None else generations(told)
    seen = rows.select(F.lit(True).alias("read"), (F.col("state") == "drift").alias("drift"), F.lit(None).cast("string").alias("cut"))
    broken = told.generations.where("problem is null and (idx is null or data is null)").select(F.lit(True), F.lit(True), F.lit(None).cast("string"))
    cut = [t.where("problem is not null").select(F.lit(False), F.lit(False), "store") for t in (told.generations, told.steps, told.heads)]
    for more in (broken, *cut):
        seen = seen.union(more)
    return seen.agg(F.count_if("read").alias("rows"), F.count_if("drift").alias("parse_errors"), F.countDistinct("cut").alias("cut_stores"))


def history_touches(lines: DataFrame) -> DataFrame:
    """Touches of ``history.jsonl``: whole seconds; without a conversation the line stands for one.

    There is one such file for all conversations, so its lines are numbered within blocks of
    places, on top of the sums of the blocks before: no task orders a whole file.
    """
    block = ["path", F.col("pos.block").alias("__block"), F.shiftright(F.col("pos.n"), BLOCK_BITS).alias("__part")]
    before = Window.partitionBy("path").orderBy("__block", "__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(*block).agg(F.count("*").alias("__rows")).select("path", "__block", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("path", "__block", "__part").orderBy("pos"))
    numbered = lines.select("*", *block[1:]).join(sums, ["path", "__block", "__part"]).withColumn("line_no", F.col("__before") + within).select(*lines.columns, "line_no")
    v = F.col("v")
    rows = parse(numbered).where("v is not null")
    ms = F.when(F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant")) == "BIGINT", F.try_variant_get(v, "$.timestamp", "bigint"))
    session = F.coalesce(text_at(v, "$.conversationId"), F.concat(F.lit("history:"), F.col("line_no").cast("string")))
    return rows.select("path", "pos", from_seconds(F.floor(ms / 1000)).alias("at"), session.alias("session_id")).where("at is not null")


def log_rows(lines: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """Prompts and tool confirmations of ``cli-<date>*.log`` files with instant and conversation.

    Lines have month, day and time in the writer's offset; the year is that of the file's name.
    The conversation is the latest that a confirmation named, else the file's.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    year = F.when(stem.rlike("^cli-.{8}"), F.try_to_number(F.regexp_extract(stem, r"^cli-(\d{4})", 1), F.lit("9999")))
    shape = rf"^(?:{SPACE})?\S(\d\d)(\d\d){SPACE}(\d+):(\d+):(\d+)(?:[:.](\d+))?"
    part = lambda n: F.regexp_extract("line", shape, n).try_cast("int")
    micro = F.coalesce(part(6), F.lit(0))
    stamp = F.when((micro < 1_000_000) & (part(5) < 60), F.try_make_timestamp_ntz(year.cast("int"), part(1), part(2), part(3), part(4), part(5).cast("decimal(8,6)")))
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp)
    moment = plausible(F.timestamp_micros(since + micro - offset_seconds * 1_000_000))
    kind = F.when(F.col("line").contains("HandleUserInput called with text"), "prompt").when(F.col("line").contains("Responding to tool confirmation"), "confirmation")
    named = bounded(F.nullif(F.regexp_extract("line", rf"convID=((?:(?!{SPACE[:-1]})[^,])*)", 1), F.lit("")))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("kind", kind).where("kind is not null").withColumn("named", F.when(F.col("kind") == "confirmation", named))
    grant = bounded(F.nullif(F.regexp_extract("line", r"command\(\s*([^)\s]*)[^)]*\)", 1), F.lit("")))
    session = F.coalesce(F.last("named", ignorenulls=True).over(upto), F.nullif(stem, F.lit("")))
    tool = F.when(F.col("kind") == "confirmation", F.coalesce(F.concat(F.lit("command:"), grant), F.lit("ToolConfirmation")))
    return rows.select("path", "pos", moment.alias("at"), session.alias("session_id"), tool.alias("tool_name")).where("at is not null and session_id is not null")


def log_tools(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.where("tool_name is not null").select("path", "pos", "at", "session_id", "tool_name", none.alias("subagent_type"), F.lit("main").alias("source_kind"), none.alias("dedupe_key"))
