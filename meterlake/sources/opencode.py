"""Decoder of message stores in two generations: legacy messages and parts, and session messages.

One message may stand in several stores and in both generations; it belongs to the first row
that parses, in the order of store names, legacy before new, then the row's place. Forks of the
new generation begin with copies of their parent's messages: their rows up to the copied place
fall away, unless parent or boundary is gone. A message's tool calls come from one generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.scalar import PATH_BYTES, bounded, from_millis, project_from_cwd
from meterlake.sources.sqlite import place, read_store
from meterlake.sources.text import bounded_json, count_at, plain_text_at

LEGACY, NEW = 0, 1
MESSAGE = "id string, session_id string, time_created long, data string"
PART = "id string, message_id string, session_id string, time_created long, data string"
SESSION_MESSAGE = "id string, session_id string, type string, seq long, time_created long, data string"
PLACE = "id string, session_id string, seq long"
FORKED, SESSION = "id string, directory string, fork_session_id string, fork_boundary string", "id string, directory string"


class Tables(NamedTuple):
    """Rows of the stores' tables as :func:`read_store` gives them."""

    message: DataFrame
    part: DataFrame
    session_message: DataFrame
    places: DataFrame
    session_v2: DataFrame
    session: DataFrame


def read_tables(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> Tables:
    """The tables of all stores; ``since_ms`` is pushed into them, forks still see all their parents' rows."""
    since = {"since": str(since_ms), "time_column": "time_created"} if since_ms is not None else {}
    return Tables(
        read_store(spark, paths, "message", MESSAGE, **since), read_store(spark, paths, "part", PART, **since), read_store(spark, paths, "session_message", SESSION_MESSAGE, **since),
        read_store(spark, paths, "session_message", PLACE), read_store(spark, paths, "session_v2", FORKED), read_store(spark, paths, "session", SESSION),
    )


def _rows(table: DataFrame) -> DataFrame:
    return table.where("problem is null").withColumn("v", bounded_json(F.col("data")))


def _whole(v: Column, path: str) -> Column:
    """A JSON integer of either sign."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def cutoffs(tables: Tables) -> DataFrame:
    """store, session_id and the highest place of its parent that a fork copied.

    The parent's rows are numbered once; a boundary before a message means the next lower place.
    """
    rows = tables.places.where("problem is null and session_id is not null and seq is not null").select("store", "session_id", "id", "seq")
    lower = F.max("seq").over(Window.partitionBy("store", "session_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    forks = tables.session_v2.where("problem is null and id is not null and fork_session_id is not null and fork_boundary is not null").withColumn("b", bounded_json(F.col("fork_boundary")))
    kind = plain_text_at(F.col("b"), "$.type")
    forks = forks.select("store", F.col("id").alias("fork"), F.col("fork_session_id").alias("session_id"), kind.alias("kind"), plain_text_at(F.col("b"), "$.messageID").alias("id")).where("kind in ('through', 'before') and id is not null")
    parents = rows.join(forks.select("store", "session_id").distinct(), ["store", "session_id"], "left_semi").withColumn("lower", lower)
    met = forks.join(parents, ["store", "session_id", "id"]).withColumn("upto", F.when(F.col("kind") == "through", F.col("seq")).otherwise(F.col("lower")))
    return met.where("upto is not null").groupBy("store", F.col("fork").alias("session_id")).agg(F.max("upto").alias("copied"))


def directories(tables: Tables) -> DataFrame:
    """store, session_id and its folder: the first known of both session tables."""
    both = tables.session_v2.select("store", "id", "directory", F.lit(0).alias("n"), "pos", "problem").union(tables.session.select("store", "id", "directory", F.lit(1), "pos", "problem"))
    known = both.where("problem is null and directory is not null and id is not null")
    return known.groupBy("store", F.col("id").alias("session_id")).agg(F.min_by("directory", F.struct("n", "pos")).alias("directory"))


def messages(tables: Tables, home: str) -> DataFrame:
    """One row for each message id over all stores and generations, with all that events need."""
    v = F.col("v")
    legacy = _rows(tables.message).where("v is not null and id is not null")
    new = _rows(tables.session_message).where("v is not null and id is not null and type is not null and seq is not null and time_created is not null").withColumn("session_id", bounded(F.col("session_id"))).where("session_id is not null")
    new = new.join(cutoffs(tables), ["store", "session_id"], "left").where("copied is null or seq > copied")
    new = new.join(directories(tables), ["store", "session_id"], "left")
    folder = lambda c: project_from_cwd(bounded(c, PATH_BYTES), home)
    token = lambda p: F.coalesce(count_at(v, f"$.tokens.{p}"), F.lit(0).cast("long"))
    has_tokens = F.try_variant_get(v, "$.tokens", "variant").isNotNull()

    def even(rows: DataFrame, generation: int, session: Column, created: Column, used: Column, model: str, project: Column, answer: Column, tools: Column) -> DataFrame:
        done = _whole(v, "$.time.completed")
        return rows.select(
            "store", F.lit(generation).alias("generation"), "pos", "id", session.alias("session_id"), created.alias("created_ms"), F.coalesce(used, F.lit(False)).alias("used"), F.coalesce(answer, F.lit(False)).alias("answer"),
            bounded(plain_text_at(v, model)).alias("model"), project.alias("project"), token("input").alias("input"), (token("output") + token("reasoning")).alias("output"), token("reasoning").alias("reasoning"),
            token("cache.read").alias("cache_read"), token("cache.write").alias("cache_creation"), F.when(done.isNotNull(), F.greatest(done - created, F.lit(0).cast("long"))).alias("duration_ms"), plain_text_at(v, "$.finish").alias("status"), tools.alias("tools"),
        )

    none = F.lit(None).cast("array<struct<name:string,at_ms:bigint>>")
    assistant = plain_text_at(v, "$.role") == "assistant"
    old = even(legacy, LEGACY, F.coalesce(bounded(F.col("session_id")), F.lit("")), _whole(v, "$.time.created"), assistant, "$.modelID", folder(plain_text_at(v, "$.path.cwd")), assistant, none)
    made = F.coalesce(_whole(v, "$.time.created"), F.col("time_created"))
    used = (F.col("type") == "assistant") | ((F.col("type") == "compaction") & has_tokens)
    blocks = F.filter(F.try_variant_get(v, "$.content", "array<variant>"), lambda x: plain_text_at(x, "$.type") == "tool")
    calls = F.filter(F.transform(blocks, lambda x: F.struct(bounded(plain_text_at(x, "$.name")).alias("name"), F.coalesce(_whole(x, "$.time.created"), made).alias("at_ms"))), lambda x: x["name"].isNotNull())
    young = even(new, NEW, F.col("session_id"), made, used, "$.model.id", folder(F.nullif("directory", F.lit(""))), F.col("type") == "assistant", F.when(F.col("type") == "assistant", calls))
    every = old.unionByName(young)
    first = every.groupBy("id").agg(F.min_by(F.struct(*[c for c in every.columns if c != "id"]), F.struct("store", "generation", "pos")).alias("x")).select("id", "x.*")
    return first.withColumn("at", from_millis(F.col("created_ms"))).where("at is not null")


def usage_events(told: DataFrame) -> DataFrame:
    """Of :func:`messages`, one event for each answer and each compaction with tokens."""
    used = told.where("used").withColumn("volume", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))
    return used.select(
        F.col("store").alias("path"), place(F.col("pos")).alias("pos"), "at", "session_id", "model", "project", F.concat(F.lit("opencode:"), "id").alias("dedupe_key"), "input", "output", "reasoning", "cache_read", "cache_creation", "volume",
        F.lit("call").alias("granularity"), F.lit("main").alias("source_kind"),
    )


def touches(told: DataFrame) -> DataFrame:
    return told.select("at", "session_id")


def durations(told: DataFrame) -> DataFrame:
    """Answers with a time of completion; one that ran backwards has length 0."""
    return told.where("answer and duration_ms is not null").select("at", "session_id", "duration_ms", F.lit(0).cast("long").alias("wait_ms"), F.lit(None).cast("long").alias("model_ms"), "status", F.lit(None).cast("string").alias("dedupe_key"))


def tool_events(tables: Tables, told: DataFrame) -> DataFrame:
    """Tool calls: of a message in both generations, those of the one that comes first over the stores."""
    v = F.col("v")
    parts = _rows(tables.part).where("v is not null and id is not null and time_created is not null").where(plain_text_at(v, "$.type") == "tool")
    parts = parts.select("store", "pos", "id", "message_id", F.coalesce(bounded(F.col("session_id")), F.lit("")).alias("session_id"), bounded(plain_text_at(v, "$.tool")).alias("tool_name"), F.coalesce(_whole(v, "$.state.time.start"), F.col("time_created")).alias("at_ms")).where("tool_name is not null")
    young = told.where(F.col("answer") & (F.col("generation") == NEW))
    rank = lambda g: F.struct("store", F.lit(g).alias("generation"))
    claims = parts.where("message_id is not null").select("message_id", rank(LEGACY).alias("at")).union(young.select(F.col("id"), rank(NEW)))
    owner = claims.groupBy("message_id").agg(F.min("at")["generation"].alias("owner"))
    old = parts.join(owner, "message_id", "left").where(F.col("owner").isNull() | (F.col("owner") == LEGACY))
    old = old.groupBy("id").agg(F.min_by(F.struct("session_id", "tool_name", "at_ms"), F.struct("store", "pos")).alias("x")).select("x.*")
    new = young.join(owner.where(F.col("owner") == NEW).select(F.col("message_id").alias("id")), "id", "left_semi").select("session_id", F.explode("tools").alias("t")).select("session_id", F.col("t.name").alias("tool_name"), F.col("t.at_ms").alias("at_ms"))
    return old.unionByName(new).select(from_millis(F.col("at_ms")).alias("at"), "session_id", "tool_name", F.lit(None).cast("string").alias("subagent_type"), F.lit("main").alias("source_kind"), F.lit(None).cast("string").alias("dedupe_key"))


def scan_stats(tables: Tables) -> DataFrame:
    """Stores, rows, rows that don't parse, and stores that were not read to their end."""
    seen = None
    for table, needed in ((tables.message, ["id"]), (tables.part, ["id", "time_created"]), (tables.session_message, ["id", "session_id", "type", "seq", "time_created"]), (tables.places, None), (tables.session_v2, None), (tables.session, None)):
        broken = F.lit(False)
        if needed:
            table = table.withColumn("v", bounded_json(F.col("data")))
            broken = F.col("v").isNull()
            for c in needed:
                broken = broken | F.col(c).isNull()
        read = F.lit(needed is not None) & F.col("problem").isNull()
        one = table.select("store", read.alias("read"), broken.alias("broken"), F.col("problem").isNotNull().alias("cut"))
        seen = one if seen is None else seen.union(one)
    return seen.agg(
        F.countDistinct("store").alias("stores"), F.count_if("read").alias("rows"), F.count_if(F.col("read") & F.col("broken")).alias("parse_errors"), F.countDistinct(F.when(F.col("cut"), F.col("store"))).alias("cut_stores")
    )
