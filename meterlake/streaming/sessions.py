"""Streaming forms: replay-free usage, windowed volumes, and inactivity stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_key(events: DataFrame, key: str = "dedupe_key", at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Drops replays of a key that arrive within the lateness."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def hourly_volume(events: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Tokens and events by hour and provider; an hour closes when the watermark passes it."""
    hours = F.window(at, "1 hour")
    out = events.withWatermark(at, lateness).groupBy(hours.alias("w"), "provider").agg(F.sum("volume").alias("volume"), F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("hour"), "provider", "volume", "events")


def inactivity_stretches(events: DataFrame, at: str = "at", silence: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Stretches of a session that a silence ends, as session windows."""
    stretch = F.session_window(at, silence)
    out = events.withWatermark(at, lateness).groupBy(stretch.alias("w"), "session_id").agg(F.count("*").alias("events"), F.sum("volume").alias("volume"))
    return out.select("session_id", F.col("w.start").alias("first_at"), "events", "volume")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what there is and returns the table so far (small results only)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
