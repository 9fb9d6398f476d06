"""Toxicity from class-conditional discounted models of byte expressions.

A text is folded (ASCII and Latin-1 letters lower-cased, other ASCII and white space to
single spaces) and read as overlapping expressions of seven bytes. For each class c
(toxic, ordinary), with n_c(g) the number of its training texts that hold g:

    P_c(g) = max(n_c(g) - D, 0) / N_c + lambda_c * P(g)

where lambda_c gives back what the discount D took, and the backoff P is one for both
classes: the share of g among all expressions of all documents. An expression that is rare
in both classes hence has the same ratio everywhere and cannot decide. This is the
discount and the shared backoff of Kneser-Ney without its histories and continuation
counts: with them, held-out accuracy falls far behind (see the README).

The length-normalised log-likelihood difference is taken over windows of sixteen
expressions and a text counts by its highest window, so a short insult in a long text is not
diluted. A logistic curve over that value and the log of the text's length, fitted on
labelled rows kept apart from the counts and weighted to the classes' true shares, makes it
a probability.

The class counts take at most ``per_class`` labelled rows of each class, chosen by the hash
of doc_id; the backoff counts all documents. Expressions are counted in 2**23 hashed cells,
so the model has a fixed size (16 MB).

Defined cases: null text is empty; an empty text has difference 0 and gets the
probability that the curve gives there; without labels of both classes every score is
the share of toxic labels, or 0; rows with null labels or ids are not learned from; a
doc_id with several labels takes one of them; a column named as the output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meterlake.llm import _kernels as K
from meterlake.llm._spark import over_arrow

GRAM, CELLS, DISCOUNT, WINDOW = 7, 1 << 23, 4, 16
PER_CLASS = 4000
THRESHOLD = 0.3
U = np.uint64


class Model(NamedTuple):
    ratios: np.ndarray  # float16, one for each cell
    weights: tuple[float, float, float]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets; every text begins with a space."""
    data, offsets = K.raw(texts)
    n = len(data)
    upper = (data >= 65) & (data <= 90)
    out = data + upper * np.uint8(32)
    after_c3 = np.zeros(n, bool)
    after_c3[1:] = data[:-1] == 0xC3
    out = out + (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)) * np.uint8(32)
    plain = (out >= 128) | ((out >= 97) & (out <= 122)) | ((out >= 48) & (out <= 57))
    out[~plain] = 32
    keep = plain.copy()
    keep[1:] |= plain[:-1]
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets] + np.arange(len(offsets))
    result = np.full(int(counts[-1]), 32, np.uint8)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))[keep]
    result[np.arange(int(keep.sum())) + rows + 1] = out[keep]
    return result, counts


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the expressions of each text: (cells, bounds)."""
    data, offsets = folded(texts)
    if len(data) < GRAM:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gram = np.zeros(len(data) - GRAM + 1, U)
    for j in range(GRAM):
        gram |= data[j : len(data) - GRAM + 1 + j].astype(U) << U(8 * j)
    sizes = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    begin = np.repeat(offsets[:-1], sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = begin + np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], sizes)
    return (K.mix(gram[at]) >> U(64 - 23)).astype(np.int64), bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, CELLS), np.int32)
    for batch in batches:
        for rows, texts in K.sliced(batch):
            toxic = rows.column(1).to_numpy(zero_copy_only=False)
            got, bounds = cells(texts)
            for i in range(len(texts)):
                total[int(toxic[i]), np.unique(got[bounds[i] : bounds[i + 1]])] += 1
    some = np.flatnonzero(total.any(axis=0))
    for i in range(0, len(some), 1 << 18):
        part = some[i : i + (1 << 18)]
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[0, part]), pa.array(total[1, part])], ["cell", "n0", "n1"])


def _shares(wanted):
    """How often the wanted cells occur, and in the row of cell -1 how many expressions there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for _, texts in K.sliced(batch):
                got = cells(texts)[0]
                whole += len(got)
                own, n = np.unique(got[wanted.value[got]], return_counts=True)
                total[own] += n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], whole))], ["cell", "n"])

    return run


def differences(texts: pa.Array, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest window of each text, and its number of expressions."""
    got, bounds = cells(texts)
    sizes = np.diff(bounds)
    sums = np.concatenate([[0.0], np.cumsum(ratios[got].astype(np.float64))])
    best = np.zeros(len(texts))
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    best[short] = (sums[bounds[short + 1]] - sums[bounds[short]]) / sizes[short]
    wide = np.flatnonzero(sizes >= WINDOW)
    if len(wide):
        means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
        edges = np.stack([bounds[wide], bounds[wide + 1] - WINDOW + 1], axis=1).ravel()
        means = np.append(means, -np.inf)
        best[wide] = np.maximum.reduceat(means, edges)[::2]
    return best, sizes


def _curve(best: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones(len(best)), best, np.log1p(sizes)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - toxic)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 4 is 0, 1 (counts) or 3 (curve)."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")).where("fold <> 2")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    nothing = Model(np.zeros(CELLS, np.float16), (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    if len(shares) < 2:
        return nothing
    rows = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows of three numbers
    chosen = F.broadcast(rows[0].union(rows[1]).dropDuplicates(["doc_id"]))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", "fold").repartition(4, F.xxhash64("text"))
    counts = texts.where("fold <> 3").select("text", "toxic").transform(over_arrow, _counts, "cell int, n0 int, n1 int")
    counts = counts.groupBy("cell").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))
    d = F.lit(DISCOUNT)
    whole = counts.agg(*[F.sum(c).alias(c) for c in ("n0", "n1")], *[F.sum(F.least(c, d)).alias(f"d{c}") for c in ("n0", "n1")]).first()
    if not whole["n0"] or not whole["n1"]:
        return nothing
    often = counts.where((F.col("n0") > d) | (F.col("n1") > d)).toPandas()  # at most CELLS rows
    n = np.stack([often["n0"], often["n1"]]).astype(float)
    total = np.array([whole["n0"], whole["n1"]], float)
    lam = np.array([whole["dn0"], whole["dn1"]]) / total
    wanted = np.zeros(CELLS, bool)
    wanted[often["cell"].to_numpy()] = True
    asked = spark.sparkContext.broadcast(wanted)
    found = docs.select("text").transform(over_arrow, _shares(asked), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    asked.unpersist()
    held_by = np.zeros(CELLS + 1)
    held_by[found["cell"].to_numpy()] = found["n"].to_numpy()  # the last one is the row of cell -1
    shared = (held_by[often["cell"].to_numpy()] + 0.5) / (held_by[-1] + 0.5 * CELLS)
    p = [np.maximum(n[c] - DISCOUNT, 0) / total[c] + lam[c] * shared for c in (0, 1)]
    ratios = np.full(CELLS, math.log(lam[1] / lam[0]), np.float16)
    ratios[often["cell"].to_numpy()] = np.log(p[1] / p[0])
    held = spark.sparkContext.broadcast(ratios)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, t in K.sliced(batch):
                best, sizes = differences(t, held.value)
                yield pa.record_batch([pa.array(best), pa.array(sizes.astype(float)), rows_.column(1).cast(pa.float64())], ["best", "size", "toxic"])

    seen = texts.where("fold = 3").select("text", "toxic").transform(over_arrow, judge, "best double, size double, toxic double").toPandas()  # at most 2 * per_class rows
    held.unpersist()
    if seen["toxic"].nunique() < 2:
        return nothing
    toxic = seen["toxic"].to_numpy()
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return Model(ratios, _curve(seen["best"].to_numpy(), seen["size"].to_numpy(), toxic, weight))


def score(docs: DataFrame, model: Model, output: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` (one named ``output`` is replaced) and the score of each text, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain, for workers that know no package yet
    docs = docs.drop(output)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, (a, b, c) = held.value
        for batch in batches:
            for rows, texts in K.sliced(batch):
                best, sizes = differences(texts, ratios)
                p = 1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(sizes), -30, 30)))
                yield pa.record_batch([*rows.columns, pa.array(p)], [*names, output])

    return docs.transform(over_arrow, run, StructType([*docs.schema.fields, StructField(output, DoubleType())]))
