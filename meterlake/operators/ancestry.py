"""Depth of forks over a table of parents, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.tables import stored

# Fixed value: a walk of so many parents is a cycle or as good as one.
DEEPEST = 64


def depths(sessions: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(node, depth) of ``sessions(node, parent)``: the number of parents above, ``deepest`` at most.

    A parent that is no node of the table counts and ends the walk. Of repeated nodes the least
    parent counts. Each round doubles what a pointer spans: a node takes its ancestor's pointer
    and adds the ancestor's span, so ``log2(deepest)`` joins on unique keys end it, cycles too.
    """
    start = sessions.where("node is not null").groupBy("node").agg(F.min("parent").alias("up"))
    state = stored(start.select("node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")))
    span = 1
    while span < deepest and state.where("up is not null").limit(1).count():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        met = state.join(above, "up", "left")
        state = stored(met.select("node", F.col("next").alias("up"), F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(deepest)).alias("depth")))
        span *= 2
    return state.select("node", "depth")
