"""Ordered passes: sweeps, streaks, gaps, carried values, predecessor lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_days(touches: DataFrame) -> DataFrame:
    """First and last touch of each session on each local day."""
    return touches.groupBy("session_id", "d").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def sweep(spans: DataFrame, by: list[str], start: str, end: str, slot: str = "MINUTE") -> DataFrame:
    """Instants where spans begin or end, with the spans open after each and the whole seconds to the next.

    Ends come before starts at one instant; spans without length are left out. Marks of one
    instant are summed before they move. Then the instants of a ``slot`` are summed in order,
    and what is open before each slot comes from the sums of the slots alone, so no task
    orders all instants of a group.
    """
    real = spans.where(F.col(start) < F.col(end))
    marks = real.select(*by, F.col(start).alias("t"), F.lit(1).cast("long").alias("delta")).union(real.select(*by, F.col(end).alias("t"), F.lit(-1).cast("long")))
    marks = marks.groupBy(*by, "t").agg(F.sum("delta").alias("delta")).withColumn("__slot", F.date_trunc(slot, F.col("t")).cast("timestamp_ntz"))
    slots = marks.groupBy(*by, "__slot").agg(F.sum("delta").alias("__sum"), F.min("t").alias("__first"))
    line = Window.partitionBy(*by).orderBy("__slot")
    before = F.coalesce(F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__slot").alias("__at"), before.alias("__before"), F.lead("__first").over(line).alias("__next"))
    same = F.col("__slot") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "__slot").orderBy("t")
    open_ = F.col("__before") + F.sum("delta").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.coalesce(F.lead("t").over(within), F.col("__next"))
    return marks.join(slots, same).select(*by, "t", "delta", open_.alias("open"), F.timestamp_diff("SECOND", F.col("t"), following).alias("seconds"))


def level(open_: Column) -> Column:
    """Index of 1, 2, 3, 4-6, 7-9, 10 and more."""
    return F.when(open_ <= 3, open_ - 1).when(open_ <= 6, 3).when(open_ <= 9, 4).otherwise(5).cast("int")


# Midpoints of the six levels.
MIDPOINTS = (1, 2, 3, 5, 8, 11)


def islands(days: DataFrame, by: list[str], day: str = "d") -> DataFrame:
    """Runs of consecutive days: first, last, length."""
    line = Window.partitionBy(*by).orderBy(day)
    runs = days.select(*by, day).distinct().withColumn("__run", F.date_sub(F.col(day), F.row_number().over(line)))
    return runs.groupBy(*by, "__run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("__run")


def inactivity_sessions(events: DataFrame, by: str, at: str, order: str, minutes: int) -> DataFrame:
    """Numbers the stretches of a key that a silence longer than ``minutes`` cuts."""
    line = Window.partitionBy(by).orderBy(at, order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(at).over(line), F.col(at))
    cut = F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("__cut", cut).withColumn("stretch", F.sum("__cut").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__cut")


def deltas(snapshots: DataFrame, by: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Cumulative counters to differences; where any counter falls, the full values count."""
    line = Window.partitionBy(*by).orderBy(*order)
    before = {c: F.lag(c).over(line) for c in counters}
    made = snapshots.select("*", *[before[c].alias(f"__{c}") for c in counters])
    reset = F.col(f"__{counters[0]}").isNull()
    for c in counters:
        reset = reset | (F.col(c) < F.col(f"__{c}"))
    for c in counters:
        made = made.withColumn(f"d_{c}", F.when(reset, F.col(c)).otherwise(F.col(c) - F.col(f"__{c}")))
    return made.drop(*[f"__{c}" for c in counters])


def carry_forward(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's last known value along the order."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in columns:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(line))
    return rows


def union_length(spans: Column) -> Column:
    """Length of the union of an array of structs (start, end) of numbers."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("upto"))

    def step(s: Column, x: Column) -> Column:
        begin = F.greatest(x["start"], F.coalesce(s["upto"], x["start"]))
        return F.struct((s["total"] + F.greatest(x["end"] - begin, F.lit(0))).cast("long").alias("total"), F.greatest(F.coalesce(s["upto"], x["end"]), x["end"]).cast("long").alias("upto"))

    return F.aggregate(ordered, zero, step, lambda s: s["total"])
