"""The call ledger of session stores against the snapshots of session event logs.

From a session's first recorded call on, its calls replace its snapshots. A session with a row
that can't be read keeps its snapshots, and of its calls only those after the latest snapshot
count; a store with a row that names no session, or that a limit cut, does so for all sessions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalar import PATH_BYTES, bounded, clamp_counter, parse_instant, plausible, project_from_cwd, saturating_sub
from meterlake.sources.sqlite import place, read_store

CALLS = "id long, session_id string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, agent_id string, initiator string, created_at string"


class Ledger(NamedTuple):
    calls: DataFrame  # usage, each with whether its session or store is incomplete
    first_call: DataFrame  # store, session_id, first_at, incomplete
    touches: DataFrame


def read_ledger(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of calls and of sessions as :func:`read_store` gives them."""
    return read_store(spark, paths, "assistant_usage_events", CALLS), read_store(spark, paths, "sessions", "id string, cwd string")


def ledger(calls: DataFrame, sessions: DataFrame, home: str) -> Ledger:
    at = F.coalesce(parse_instant(F.col("created_at")), plausible(F.try_to_timestamp(F.when(F.col("created_at").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.col("created_at")), F.lit("yyyy-MM-dd HH:mm:ss"))))
    rows = calls.withColumn("session_id", bounded(F.col("session_id"))).withColumn("model", bounded(F.col("model"))).withColumn("at", at)
    fine = F.col("problem").isNull() & F.col("id").isNotNull() & F.col("session_id").isNotNull() & F.col("model").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumn("fine", fine)
    broken = rows.where(~F.col("fine")).groupBy("store", "session_id").agg(F.lit(True).alias("incomplete"))
    whole = broken.where("session_id is null").select("store", F.lit(True).alias("unattributed"))
    good = rows.where("fine").join(broken.where("session_id is not null"), ["store", "session_id"], "left").join(whole, "store", "left")
    good = good.withColumn("incomplete", F.coalesce("incomplete", "unattributed", F.lit(False))).drop("unattributed")
    folders = sessions.where("problem is null and id is not null").groupBy("store", F.col("id").alias("session_id")).agg(F.min_by("cwd", "pos").alias("cwd"))
    good = good.join(folders, ["store", "session_id"], "left")
    count = lambda c: clamp_counter(F.col(c))
    fresh = saturating_sub(saturating_sub(count("input_tokens"), count("cache_read_tokens")), count("cache_write_tokens"))
    own = F.col("agent_id").isNull() & ~F.coalesce(F.col("initiator") == "sub-agent", F.lit(False))
    usage = good.select(
        F.col("store").alias("path"), place(F.col("pos")).alias("pos"), "at", "session_id", "model", project_from_cwd(bounded(F.col("cwd"), PATH_BYTES), home).alias("project"), F.concat(F.lit("copilot-call:"), F.col("id").cast("string")).alias("dedupe_key"),
        fresh.alias("input"), count("output_tokens").alias("output"), count("reasoning_tokens").alias("reasoning"), count("cache_read_tokens").alias("cache_read"), count("cache_write_tokens").alias("cache_creation"),
        F.lit("call").alias("granularity"), F.when(own, "main").otherwise("subagent").alias("source_kind"), "incomplete",
    )
    usage = usage.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation")).where("volume > 0")
    first = good.groupBy("session_id").agg(F.min("at").alias("first_at"), F.max("incomplete").alias("incomplete"))
    return Ledger(usage, first, good.select("at", "session_id"))


def reconcile(snapshots: DataFrame, book: Ledger) -> tuple[DataFrame, DataFrame]:
    """(snapshots, calls) that count: no call twice, none lost.

    A key that is dropped under one session is dropped wherever it stands, so that a fork's copy
    of a replaced snapshot does not count again.
    """
    covered = snapshots.where("session_id is not null and at is not null").groupBy("session_id").agg(F.max("at").alias("covered"))
    calls = book.calls.join(covered, "session_id", "left").where("not incomplete or covered is null or at > covered").drop("covered", "incomplete")
    first = book.first_call.join(covered, "session_id", "left").where("not incomplete or covered is null").select("session_id", "first_at")
    marked = snapshots.join(first, "session_id", "left").withColumn("dead", F.col("first_at").isNotNull() & ~F.coalesce(F.col("at") < F.col("first_at"), F.lit(False)))
    gone = marked.where("dead and dedupe_key is not null").select("dedupe_key").distinct()
    kept = marked.where("not dead").drop("dead", "first_at").join(gone, "dedupe_key", "left_anti")
    return kept.select(*snapshots.columns), calls
