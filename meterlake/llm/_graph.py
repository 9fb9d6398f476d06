"""Connected components over link tables: local union-find, then star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm._spark import over_arrow, shuffle_partitions, stage_table

CHUNK = 1 << 19


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) over one bounded chunk of links; arrays, no recursion."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:  # path halving until every node points at a root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return nodes, nodes[parent]


def _contract(chunk: int):
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        node, root = union_find(u, v)
        link = node != root
        return pa.record_batch([pa.array(node[link]), pa.array(root[link])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.slice(at, chunk)
                if n + len(part) > chunk:
                    yield flush(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield flush(held)

    return run


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component): the least node that each node of ``links(u, v)`` reaches.

    A task takes about ``chunk`` links and contracts them by union-find, so tasks grow in
    number and not in size. Where one chunk holds all links that is the result. Otherwise
    star rounds follow: all roots of a node, and the node, hang under its least root, a root
    that hangs under another takes its nodes along, and the links are dealt by their greater
    node and contracted again, until every node has one root that is a root itself.
    Nulls and self-links are ignored.
    """
    star = links.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    tasks = -(-max(1, star.count()) // chunk)
    star = stage_table(star.coalesce(tasks).transform(over_arrow, _contract(chunk), "u long, v long"), "star")
    while tasks > 1:
        # one row a node: its roots, and whether it is a child, a root or both
        ends = star.select(F.col("u").alias("x"), "v", F.lit(1).alias("child")).union(star.select("v", F.lit(None).cast("long"), F.lit(0)))
        state = ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("child").alias("c1"), F.min("child").alias("c0"))
        if not state.where("least < most or c0 < c1").limit(1).count():
            break
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        roots = star.join(least, "u")
        hung = roots.select("u", F.col("m").alias("v")).union(roots.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        up = hung.groupBy("u").agg(F.min("v").alias("up"))
        taken = hung.join(up.select(F.col("u").alias("v"), "up"), "v", "left").select("u", "v", "up")
        star = taken.select("u", F.coalesce("up", "v").alias("v")).union(taken.where("up is not null").select(F.col("v").alias("u"), F.col("up").alias("v"))).where("u <> v")
        star = stage_table(star.repartition(shuffle_partitions(star.sparkSession), F.greatest("u", "v")).transform(over_arrow, _contract(chunk), "u long, v long").distinct(), "star")
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(star.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
