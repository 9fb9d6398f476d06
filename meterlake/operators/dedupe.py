"""Keyed deduplication of replayed records. Rows with a null key are always kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_usage(events: DataFrame, key: list[str], volume: str, order: list[str], at: str, counters: list[str], metadata: list[str]) -> DataFrame:
    """Folds the rows of a key in arrival order: the larger volume wins and takes what it lacks
    from the loser; the earliest time stays.

    A row is a record if its volume exceeds all before it. The fold lets records come first,
    newest to oldest, then the others in order; each metadata field is the first known along
    that line, and the counters are the newest record's.
    """
    arrival = Window.partitionBy(*key).orderBy(*order)
    ranked = events.withColumn("__n", F.row_number().over(arrival))
    most = F.max(volume).over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("__record", F.col(volume) > F.coalesce(most, F.lit(-1)))
    line = F.struct(~F.col("__record"), F.when(F.col("__record"), -F.col("__n")).otherwise(F.col("__n")))
    ranked = ranked.withColumn("__line", line)
    found = [F.min_by(F.struct(volume, *counters), "__line").alias("__x")]  # compared once for all counters
    found += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__line"))).alias(c) for c in metadata]
    return ranked.groupBy(*key).agg(F.min(at).alias(at), *found).select(*key, at, *[F.col("__x")[c].alias(c) for c in (volume, *counters)], *metadata)


def keep_longest(events: DataFrame, key: list[str], duration: str, order: list[str], at: str, others: list[str]) -> DataFrame:
    """The row with the longest duration (the first of equals), with the earliest time among equals."""
    ranked = events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    top = F.max(duration).over(Window.partitionBy(*key))
    longest = ranked.withColumn("__top", top).where(F.col(duration) == F.col("__top"))
    return longest.groupBy(*key).agg(F.min(at).alias(at), F.max(duration).alias(duration), *[F.min_by(c, "__n").alias(c) for c in others])


def keep_first(events: DataFrame, key: list[str], order: list[str], at: str | None, others: list[str]) -> DataFrame:
    """The first row of a key; its time becomes the earliest of the key if ``at`` is given."""
    ranked = F.struct(*order)
    times = [F.min(at).alias(at)] if at else []
    first = events.groupBy(*key).agg(*times, F.min_by(F.struct(*others), ranked).alias("__x"))
    return first.select(*key, *([at] if at else []), *[F.col("__x")[c].alias(c) for c in others])


def merge_flags(events: DataFrame, key: list[str], at: str, flags: list[str]) -> DataFrame:
    """Flags are true if any row's is; the earliest time stays."""
    return events.groupBy(*key).agg(F.min(at).alias(at), *[F.bool_or(c).alias(c) for c in flags])


def strongest(events: DataFrame, key: list[str], strength: str, order: str, others: list[str]) -> DataFrame:
    """The row with the greatest strength, the first of equals."""
    rank = F.struct(F.col(strength), -F.col(order))
    return events.groupBy(*key).agg(F.max(strength).alias(strength), *[F.max_by(c, rank).alias(c) for c in others])


def keyed(events: DataFrame, key: str, fold) -> DataFrame:
    """Applies ``fold`` to the rows that have a key; the others pass unchanged."""
    folded = fold(events.where(F.col(key).isNotNull()))
    return folded.unionByName(events.where(F.col(key).isNull()).select(*folded.columns))
