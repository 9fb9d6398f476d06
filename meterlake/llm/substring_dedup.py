"""Substring dedup over a log-structured index of window fingerprints.

A window is 50 consecutive words. Its anchor is the least hash among its 26 runs of
25 words (leftmost on ties), so equal windows have equal anchors. Neighbouring windows
with one anchor form a segment; a document has one posting (anchor, segment hash,
place) for each segment, about one for thirteen words.

Texts equal to one of a smaller doc_id (by SHA-256) have all their windows repeated; they
are told apart first, by one grouping of hashes, and have no postings.

The index holds, for each different segment, its least document. Every batch adds one
immutable run, a table bucketed by anchor. A batch's postings are shuffled once, into such
a table too; from there on it is grouped, and merge-joined with each run, on the anchor
without moving either side. Of what it meets there:

* segments equal to one of an earlier document are repeated as a whole: all postings but
  those of the segment's first document, found by segment and document together;
* anchors that occur with several different segments are verified window by window (the
  anchor's 64-bit hash and one of all 50 words), once for each different segment.

Runs are compacted into one, with the least document of each segment, when more than
``fan`` have gathered. Anchors that hold a thousandth of a batch's postings or more (a
frequent-items sketch names a few thousand at most) lie apart and are not bucketed. A document is compared with
documents of smaller doc_id in its own batch and in the index; batches are expected in
ascending doc_id, as :func:`remove_repeats` makes them.

Defined cases: null text has no words; texts under 50 words have no windows; rows with
a null doc_id are neither changed nor sources; rows repeating a doc_id are treated by
their own texts and are no sources for each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import _kernels as K
from meterlake.llm._spark import over_arrow, shuffle_partitions, stage_table

WINDOW, GRAM = 50, 25
SPAN = WINDOW - GRAM + 1
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
HOT_SHARE, HOT_LEAST = 1000, 1000  # a key is hot from a thousandth of the rows, and 1,000 rows, on
TRACKED = 16384  # items of the sketch; it misses no key above 1 / (0.75 * TRACKED) of the rows
BROADCAST_ROWS = 200_000  # of documents, 16 bytes each and 8 for each of their spans or anchors
ALL = 2**31 - 1  # as a span's number of windows: all from its place on
U = np.uint64


def _windows(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Valid window starts, their text's row, anchor hash and anchor place (all in words of the slice)."""
    hashes = K.word_hashes(words)
    n = len(hashes)
    if n < WINDOW:
        return hashes, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    starts = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    grams = K.rolling(hashes, GRAM, BASES[0])
    least = K.window_extreme(grams, SPAN, True)
    # leftmost place of the least: the next occurrence of that value at or after the start
    place = np.full(len(least), -1, np.int64)
    for j in range(SPAN - 1, -1, -1):
        hit = grams[j : j + len(least)] == least
        place[hit] = np.flatnonzero(hit) + j
    return hashes, starts, row[starts], place[starts]


def _segments(starts: np.ndarray, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index (into starts) of each run of windows that share an anchor's place."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero((np.diff(places) != 0) | (np.diff(rows) != 0) | (np.diff(starts) != 1)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1


def _cut(words: K.Words) -> tuple[np.ndarray, ...]:
    """Of each segment: row, first word, windows, anchor hash, segment hash; and the hashes of the words."""
    hashes, starts, rows, places = _windows(words)
    first, last = _segments(starts, rows, places)
    a, b = starts[first], starts[last] + WINDOW
    grams = K.rolling(hashes, GRAM, BASES[0])
    with np.errstate(over="ignore"):
        base = U(BASES[1])
        powers = np.cumprod(np.concatenate([[U(1)], np.full(max(0, len(hashes) - 1), base, U)]))
        back = np.cumprod(np.concatenate([[U(1)], np.full(len(hashes), U(pow(int(base), -1, 1 << 64)), U)]))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * powers)]) if len(hashes) else np.zeros(1, U)
        seg = K.mix(K.mix((sums[b] - sums[a]) * back[a]) + ((b - a) * 131 + places[first] - a).astype(U))
    return rows[first], a, b - a - WINDOW + 1, grams[places[first]], seg, hashes


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows_, texts in K.sliced(batch):
            words = K.split_words(texts)
            row, a, n, fp, seg, _ = _cut(words)
            of = pa.array(row)
            ids = rows_.column(0).cast(pa.int64()).take(of)
            yield pa.record_batch(
                [K.as_long(fp), K.as_long(seg), ids, rows_.column(2).take(of), pa.array(a - words.bounds[row], pa.int32()), pa.array(n, pa.int32()), rows_.column(3).take(of)],
                ["fp", "seg", "doc_id", "tk", "at", "n", "batch"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each window of the segments whose anchor is among the row's ``fps``."""
    for batch in batches:
        for rows_, texts in K.sliced(batch):
            words = K.split_words(texts)
            row, a, n, fp, seg, hashes = _cut(words)
            if not len(row):
                continue
            wanted = rows_.column(2)
            owner = np.repeat(np.arange(len(texts), dtype=U), wanted.value_lengths().to_numpy(zero_copy_only=False))
            asked = wanted.flatten().to_numpy(zero_copy_only=False).view(U)
            with np.errstate(over="ignore"):
                take = np.flatnonzero(np.isin(K.mix(fp + row.astype(U) * U(BASES[2])), K.mix(asked + owner * U(BASES[2]))))
            of = np.repeat(take, n[take])
            rel = np.arange(len(of)) - np.repeat(np.cumsum(n[take]) - n[take], n[take])
            whole = K.rolling(hashes, WINDOW, BASES[1])[a[of] + rel]
            ids = rows_.column(0).cast(pa.int64()).take(pa.array(row[of]))
            yield pa.record_batch([K.as_long(fp[of]), K.as_long(seg[of]), ids, pa.array(rel, pa.int32()), K.as_long(whole)], ["fp", "seg", "d", "rel", "h"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in K.sliced(batch):
            words = K.split_words(texts)
            total = np.diff(words.bounds)
            spans = rows.column(2)
            lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = spans.flatten()
            owner = np.repeat(np.arange(len(texts)), lengths)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            if len(owner):
                at, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                n = np.minimum(n, total[owner] - WINDOW + 1 - at)
                begin = (words.bounds[owner] + at)[n > 0]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n[n > 0] + WINDOW - 1, -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
            yield pa.record_batch(
                [rows.column(0), join_words(words, keep), pa.array(total, pa.int64()), pa.array(total - np.diff(kept), pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )


def join_words(words: K.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[keep]
    starts, lengths = words.starts[keep], words.lengths[keep]
    final = np.ones(len(row), bool)
    final[:-1] = row[1:] != row[:-1]
    room = lengths + ~final
    ends = np.cumsum(room)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(ends - room, lengths) + step] = words.data[np.repeat(starts, lengths) + step]
    offsets = np.zeros(len(words.bounds), np.int64)
    np.add.at(offsets, row + 1, room)
    # 32-bit offsets suffice: a slice holds about SLICE_BYTES, or one text that Spark itself holds in one value
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.cumsum(offsets).astype(np.int32)), pa.py_buffer(out))


class Run(NamedTuple):
    """Different segments (fp, seg, d, tk): ``cold`` is bucketed by anchor, ``hot`` holds the anchors ``names``."""

    name: str
    cold: DataFrame
    hot: DataFrame
    names: list[int]


def hot_limit(rows: int) -> int:
    return max(HOT_LEAST, rows // HOT_SHARE)


def hot_anchors(rows: DataFrame) -> list[int]:
    """Anchors of ``rows(fp)`` above the limit, by a frequent-items sketch."""
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(fp, {2 * HOT_SHARE}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] > hot_limit(found["n"])]


def not_first(rows: DataFrame, firsts: DataFrame, on: list[str], own: str, first: str) -> DataFrame:
    """``rows`` whose ``own`` id is not the least of their group, which ``firsts`` holds for each group.

    The join goes by group and id together, so a group of any size spreads over all tasks and
    each row comes out of it once.
    """
    marks = firsts.select(*on, F.col(first).alias(own), F.lit(True).alias("__first"))
    return rows.join(marks, [*on, own], "left").where("__first is null").drop("__first")


class WindowIndex:
    """Runs of all batches so far, newest last."""

    def __init__(self, spark: SparkSession, fan: int = 4) -> None:
        self.spark, self.fan, self.buckets = spark, fan, shuffle_partitions(spark)
        self.runs: list[Run] = []
        self.tables: list[str] = []

    def bucketed(self, rows: DataFrame, name: str, into: str | None = None) -> str:
        """Writes ``rows``, which lie in tasks by anchor, as (or into) a table of the warehouse bucketed by it."""
        table = into or f"{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp", "seg").mode("append").saveAsTable(table)
        if not into:
            self.tables.append(table)
        return table

    def among(self, names: list[int]) -> DataFrame:
        """The hot anchors, to be broadcast: at most 2 * HOT_SHARE for each run."""
        return F.broadcast(self.spark.createDataFrame([(x,) for x in names], "fp long"))

    def add(self, new: DataFrame, corpus: DataFrame) -> DataFrame:
        """Spans (doc_id, tk, at, n) of repeated windows among the postings ``new``; the batch joins the index.

        ``corpus`` holds the texts (doc_id, text, tk) of the batch and of all earlier batches.
        """
        if len(self.runs) > self.fan:
            self.compact()
        names = sorted(set(hot_anchors(new)).union(*[run.names for run in self.runs]))
        hot_new = stage_table(new.join(self.among(names), "fp"), "hot_postings")
        cold_new = self.spark.table(self.bucketed(new.join(self.among(names), "fp", "left_anti").repartition(self.buckets, "fp"), "postings"))

        first = [F.min(F.struct("doc_id", "tk")).alias("x"), F.max("doc_id").alias("top"), F.count("*").alias("k")]
        columns = ["fp", "seg", "x.doc_id AS d", "x.tk AS tk", "top", "k"]
        name = self.bucketed(cold_new.groupBy("fp", "seg").agg(*first).selectExpr(*columns), "run")
        own_cold = self.spark.table(name)
        own_hot = stage_table(hot_new.groupBy("fp", "seg").agg(*first).selectExpr(*columns), "run_hot")

        # what the runs hold of the batch's anchors; neither cold side moves
        known, known_hot = own_cold, own_hot
        if self.runs:
            table = self.bucketed(own_cold, "known")
            old = ["fp", "seg", "d", "tk", "d AS top", "0L AS k"]
            for run in self.runs:
                self.bucketed(run.cold.join(own_cold.select("fp").hint("merge"), "fp", "left_semi").selectExpr(*old), "known", table)
                known_hot = known_hot.union(run.cold.join(self.among(names), "fp", "left_semi").selectExpr(*old)).union(run.hot.selectExpr(*old))
            known = self.spark.table(table)
        self.runs.append(Run(name, own_cold.select("fp", "seg", "d", "tk"), own_hot.select("fp", "seg", "d", "tk"), names))

        least = [F.min(F.struct("d", "tk")).alias("x"), F.max("top").alias("top"), F.sum("k").alias("k")]
        columns = ["fp", "seg", "x.d AS d", "x.tk AS tk", "top", "k"]
        merged = known.groupBy("fp", "seg").agg(*least).selectExpr(*columns) if len(self.runs) > 1 else own_cold
        merged_hot = stage_table(known_hot.groupBy("fp", "seg").agg(*least).selectExpr(*columns), "merged_hot")

        firsts = merged.where("k > 0").select("fp", "seg", "d").union(merged_hot.where("k > 0").select("fp", "seg", "d"))
        whole = not_first(new, firsts, ["fp", "seg"], "doc_id", "d").select("doc_id", "tk", "at", "n")

        several = lambda t: t.groupBy("fp").agg(F.count("*").alias("many"), F.min("d").alias("lo"), F.max("top").alias("hi"), F.max("k").alias("k")).where("many > 1 and lo < hi and k > 0").select("fp")
        asked = merged.join(several(merged).hint("merge"), "fp").select("d", "tk", "fp").union(merged_hot.join(F.broadcast(several(merged_hot)), "fp").select("d", "tk", "fp"))
        asked = stage_table(asked.groupBy(F.col("d").alias("doc_id"), "tk").agg(F.collect_set("fp").alias("fps")), "asked")
        texts = corpus.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, ["doc_id", "tk"]).select("doc_id", "text", "fps")
        windows = stage_table(texts.transform(over_arrow, _verify, "fp long, seg long, d long, rel int, h long"), "windows")
        least = windows.groupBy("fp", "h").agg(F.min("d").alias("first"))
        parts = not_first(windows, least, ["fp", "h"], "d", "first").select("fp", "seg", "d", "rel").distinct()
        some = new.join(parts.withColumnRenamed("d", "doc_id"), ["fp", "seg", "doc_id"]).select("doc_id", "tk", (F.col("at") + F.col("rel")).alias("at"), F.lit(1).alias("n"))
        spans = stage_table(whole.union(some), "spans")
        self.keep([run.name for run in self.runs])
        return spans

    def compact(self) -> None:
        """Merges all runs into one, which keeps the least document of each segment."""
        names = sorted(set().union(*[run.names for run in self.runs]))
        table, hot = None, []
        for run in self.runs:
            table = self.bucketed(run.cold.join(self.among(names), "fp", "left_anti"), "runs", table)
            hot += [run.cold.join(self.among(names), "fp"), run.hot]
        least = lambda t: t.groupBy("fp", "seg").agg(F.min(F.struct("d", "tk")).alias("x")).select("fp", "seg", "x.d", "x.tk")
        name = self.bucketed(least(self.spark.table(table)), "run")
        every = hot[0].select("fp", "seg", "d", "tk")
        for part in hot[1:]:
            every = every.union(part.select("fp", "seg", "d", "tk"))
        self.runs = [Run(name, self.spark.table(name), stage_table(least(every), "run_hot"), names)]
        self.keep([name])

    def keep(self, names: list[str]) -> None:
        """Drops all other tables, with their files."""
        for table in set(self.tables) - set(names):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = list(names)

    def close(self) -> None:
        """Drops the index."""
        self.keep([])
        self.runs = []


def postings(docs: DataFrame) -> DataFrame:
    """The postings of ``docs(doc_id, text, tk, batch)``."""
    return docs.select("doc_id", "text", "tk", "batch").transform(over_arrow, _postings, "fp long, seg long, doc_id long, tk int, at int, n int, batch int")


def later_copies(known: DataFrame) -> DataFrame:
    """(doc_id, tk) of rows whose text, long enough for a window, is also that of a smaller doc_id."""
    prints = known.where(F.length("text") >= 2 * WINDOW - 1).select("doc_id", "tk", F.unhex(F.sha2("text", 256)).alias("print"))
    prints = stage_table(prints, "prints")
    return not_first(prints, prints.groupBy("print").agg(F.min("doc_id").alias("first")), ["print"], "doc_id", "first").select("doc_id", "tk")


def remove_repeats(docs: DataFrame, batches: int = 3, fan: int = 1) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed for each row of docs.

    The documents pass through the index in ``batches`` ranges of doc_id.
    """
    corpus = docs.select("doc_id", "text", F.hash("text").alias("tk"))
    known = corpus.where("doc_id is not null")
    cuts = known.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    copies = stage_table(later_copies(known), "copies")
    fresh = known.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, ["doc_id", "tk"], "left_anti")
    every = stage_table(postings(fresh.withColumn("batch", batch)), "postings", ["batch"])
    index, spans = WindowIndex(docs.sparkSession, fan), copies.select("doc_id", "tk", F.lit(0).alias("at"), F.lit(ALL).alias("n"))
    try:
        for i in range(len(cuts) + 1):
            seen = known.where(F.col("doc_id") <= cuts[i]) if i < len(cuts) else known
            spans = spans.union(index.add(every.where(F.col("batch") == i).drop("batch"), seen))
    finally:
        index.close()
    gathered = stage_table(spans.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "gathered")
    size = gathered.agg(F.count("*").alias("rows"), F.sum(F.size("spans")).alias("spans")).first()
    if size["rows"] + (size["spans"] or 0) <= BROADCAST_ROWS:
        gathered = F.broadcast(gathered)
    full = corpus.join(gathered, ["doc_id", "tk"], "left").select("doc_id", "text", "spans")
    return full.transform(over_arrow, _rewrite, "doc_id long, text string, n_words long, n_removed long")
