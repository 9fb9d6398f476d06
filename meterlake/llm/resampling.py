"""Quality by importance resampling over hashed n-gram models.

Words and word pairs of a text (A-Z lower-cased) are hashed into 2**14 cells. Two
categorical models are counted over them: one for the raw text, from every document, and
one for the target, from documents labelled as good. A document's log weight is the mean
log ratio of the two models over its n-grams, times a reference length of 200 n-grams, so
that long and short documents compete alike. Adding a Gumbel variable drawn from the
doc_id's hash and keeping the k largest is sampling without replacement in proportion to
the weights. The k-th largest key is found by counting keys in ever finer bins, so no
more than a bin's counts or ``FEW`` rows reach the driver.

k is ``share`` of all rows; without it, the share of good ones among the labels. At most
``TARGET_ROWS`` labelled rows make the target, chosen by the hash of doc_id; rows whose
crc32(doc_id as text) mod 4 is 2 are never used, so they can test the result.

Defined cases: null text is empty, and a text without words has log weight 0; without good
labels all weights are 0 and the sample is uniform; rows that tie with the k-th (equal
key and doc_id) are kept with it; a null doc_id draws like any other value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import _kernels as K
from meterlake.llm._spark import over_arrow, stage_table

BITS, LENGTH, TARGET_ROWS, FEW, BINS = 14, 200, 20_000, 1000, 2048
U = np.uint64


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of a slice of texts, and the row of each."""
    words = K.split_words(texts, True)
    hashes = K.word_hashes(words)
    rows = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    pairs = K.ngrams(hashes, 2)
    same = rows[1:] == rows[:-1] if len(rows) else np.empty(0, bool)
    shift = U(64 - BITS)
    return (np.concatenate([hashes, pairs[same]]) >> shift).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for slice_, texts in K.sliced(batch):
            got, rows = cells(texts)
            target = slice_.column(1).to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(got, minlength=1 << BITS)
            total[1] += np.bincount(got[target[rows]], minlength=1 << BITS)
    some = np.flatnonzero(total[0])
    yield pa.record_batch([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["cell", "raw", "target"])


def ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of the target's and the raw text's model in each cell."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold != 2)).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("target", F.lit(True))
    # at most target_rows rows of one number
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.transform(over_arrow, _counts, "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counts.toPandas()  # at most 2**BITS rows
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    raw[found["cell"]] += found["raw"]
    target[found["cell"]] += found["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if found["target"].sum() else np.zeros(1 << BITS)


def _weights(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for slice_, texts in K.sliced(batch):
                got, rows = cells(texts)
                sums = np.bincount(rows, table[got], minlength=len(texts))
                sizes = np.bincount(rows, minlength=len(texts))
                yield pa.record_batch([slice_.column(0), pa.array(sums / np.maximum(sizes, 1) * LENGTH)], ["doc_id", "log_weight"])

    return run


def weigh(docs: DataFrame, table: np.ndarray, seed: int = 1) -> DataFrame:
    """doc_id, log_weight and the Gumbel-perturbed key of every document."""
    held = docs.sparkSession.sparkContext.broadcast(table)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(over_arrow, _weights(held), "doc_id long, log_weight double")
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(drawn)))


def top(keyed: DataFrame, k: int) -> DataFrame:
    """The rows with the k largest (key, doc_id)."""
    bounds = keyed.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if k >= bounds["n"]:
        return keyed
    if k <= 0:
        return keyed.limit(0)
    lo, hi, left = bounds["lo"], bounds["hi"], k
    while True:
        # rows above hi are taken; the cut lies in [lo, hi]
        inside = keyed.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).alias("bin")
        bins = inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for row in bins:
            if row["n"] >= left:
                break
            left -= row["n"]
        lo, hi = row["lo"], row["hi"]
        inside = keyed.where((F.col("key") >= lo) & (F.col("key") <= hi))
        if row["n"] <= FEW or lo == hi:
            break
    last = inside.select("key", "doc_id").orderBy(F.desc("key"), F.desc_nulls_last("doc_id")).limit(left).agg(F.min("key").alias("key"), F.min_by("doc_id", F.struct("key", "doc_id")).alias("doc_id")).first()
    tie = F.lit(True) if last["doc_id"] is None else F.col("doc_id") >= last["doc_id"]
    return keyed.where((F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & tie))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The sampled documents: doc_id, log_weight, key."""
    if share is None:
        known = labels.where("quality in (0, 1)").agg(F.avg("quality").alias("x")).first()["x"]
        share = 1.0 if known is None else known
    keyed = stage_table(weigh(docs, ratios(docs, labels)), "weights")
    return top(keyed, math.ceil(share * keyed.count()))
