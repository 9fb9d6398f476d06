"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine c are apart by sqrt(2 - 2c). The vectors are rotated by a fixed
random orthogonal matrix and cut into blocks of eight dimensions; each block gets the part
of the squared distance that its dimensions make up. If a pair keeps the whole budget, it
keeps at least one block's. So every block is range-joined by itself: on its first three
dimensions in grid cells of twice its radius, then on the distance in all eight. Each
vector stands in its own cell and is sent to the neighbouring cells that its radius
touches and that come later in order, hence each pair meets at most once a block. The
union of the blocks' pairs is verified by the cosine in double precision.

Equal vectors of a label are collapsed first and count with their number. The joins are
plain equi-joins with a distance condition, so Spark splits an overfull cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label or vec_id, link with nothing; vectors of different lengths
don't link; rows repeating a vec_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm._graph import components
from meterlake.llm._spark import over_arrow, stage_table

COSINE, BLOCK, GRID = 0.98, 8, 3


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def _cells(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[begin[rows][:, None] + np.arange(size)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = x @ rotation(int(size))
                for b, at in enumerate(range(0, int(size), BLOCK)):
                    part = x[:, at : at + BLOCK]
                    budget = (2 - 2 * cosine) * part.shape[1] / size * (1 + 1e-9) + 1e-12
                    radius = np.sqrt(budget)
                    grid = part[:, :GRID]
                    low, high = np.floor((grid - radius) / (2 * radius)), np.floor((grid + radius) / (2 * radius))
                    home = np.floor(grid / (2 * radius))
                    wide = np.zeros((len(rows), BLOCK))
                    wide[:, : part.shape[1]] = part
                    for side in product((0, 1), repeat=grid.shape[1]):
                        cell = np.where(np.array(side) == 1, high, low)
                        # a dimension that touches one cell only would repeat it
                        real = ((np.array(side) == 0) | (high > low)).all(axis=1)
                        step = cell - home
                        lead = np.zeros(len(rows))
                        for k in range(grid.shape[1] - 1, -1, -1):
                            lead = np.where(step[:, k] != 0, step[:, k], lead)
                        take = real & (lead >= 0)
                        n = int(take.sum())
                        if n:
                            keys = np.zeros((n, GRID), np.int64)
                            keys[:, : grid.shape[1]] = cell[take].astype(np.int64)
                            yield pa.record_batch(
                                [pa.array(ids[rows][take]), pa.array(labels[rows][take]), pa.array(np.full(n, size * 1000 + b, np.int64)), pa.array(np.full(n, budget))]
                                + [pa.array(keys[:, k]) for k in range(GRID)]
                                + [pa.array(lead[take] == 0)]
                                + [pa.array(wide[take][:, k]) for k in range(BLOCK)],
                                ["id", "label", "block", "budget", *[f"g{k}" for k in range(GRID)], "home", *[f"x{k}" for k in range(BLOCK)]],
                            )

    return run


def _cosines(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
            heads = np.cumsum(sizes) - sizes
            with np.errstate(over="ignore", invalid="ignore"):
                if len(a):
                    big = np.repeat(np.maximum.reduceat(np.abs(x), heads), sizes), np.repeat(np.maximum.reduceat(np.abs(y), heads), sizes)
                    x, y = x / big[0], y / big[1]
                    dot, p, q = (np.add.reduceat(v, heads) for v in (x * y, x * x, y * y))
                    near = dot / np.sqrt(p * q) >= cosine
                else:
                    near = np.zeros(0, bool)
            yield pa.record_batch([pa.array(b[near]), pa.array(a[near])], ["u", "v"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    good = rows.where(F.coalesce(usable, F.lit(False)))
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("many"))
    classes = stage_table(classes, "classes")
    names = ["id", "label", "block", "budget", "g0", "g1", "g2", "home", *[f"x{k}" for k in range(BLOCK)]]
    kinds = ", ".join(f"{n} {'boolean' if n == 'home' else 'double' if n[0] == 'x' or n == 'budget' else 'long'}" for n in names)
    cells = stage_table(classes.select("rep", "label", "vec").transform(over_arrow, _cells(cosine), kinds), "cells")
    a, b = cells.where("home").alias("a"), cells.alias("b")
    same = F.expr(" AND ".join(f"a.{k} = b.{k}" for k in ("label", "block", "g0", "g1", "g2")))
    apart = " + ".join(f"(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})" for k in range(BLOCK))
    met = a.join(b, same & F.expr(f"a.id <> b.id AND (NOT b.home OR a.id < b.id) AND {apart} <= a.budget"))
    pairs = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    by = classes.select("rep", "vec")
    full = pairs.join(by.select(F.col("rep").alias("a"), F.col("vec").alias("p")), "a").join(by.select(F.col("rep").alias("b"), F.col("vec").alias("q")), "b")
    links = stage_table(full.select("a", "b", "p", "q").transform(over_arrow, _cosines(cosine), "u long, v long"), "links")
    ends = links.select(F.col("u").alias("rep"), F.col("v").alias("other")).union(links.select("v", "u"))
    counts = ends.join(classes.select(F.col("rep").alias("other"), "many"), "other").groupBy("rep").agg(F.sum("many").alias("linked"))
    comps = components(links).select(F.col("node").alias("rep"), "component")
    known = classes.join(counts, "rep", "left").join(comps, "rep", "left")
    known = known.select("label", "vec", (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    joined = good.select("vec_id", "label", "vec").join(known, ["label", "vec"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long"), "vec_id")
    out = joined.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
