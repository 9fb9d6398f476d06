"""Ranked lexical search with Block-Max WAND over shards of documents.

``build_index`` cuts the documents of each task into shards of about ``SHARD_BYTES`` of text
and inverts each shard where it is read, so no posting is shuffled and a frequent term is
spread over all shards. A term's postings in a shard are blocks of ``BLOCK`` documents:
delta and frequency as variable-length bytes, and beside them, uncompressed, each block's
last document, its greatest impact and its offset.

``search`` joins the index with the terms of the query items (a counted table), and deals
the matching postings by shard and block of items. Inside a shard the ends of all blocks of
an item's terms cut its documents into segments; in one segment each term has one block, so
the sum of the blocks' greatest impacts bounds every score there (the shallow moves). The
segments are opened from the highest bound down, and only the blocks that an opened segment
touches are decompressed; once the bounds fall below the item's threshold, the k-th best
score so far, the rest is skipped. The threshold is carried from shard to shard inside a task.
Equal bounds are opened, since a tie may go to the smaller doc_id.

Defined cases: null and empty texts have no term, don't count in N and never match; rows
repeating a doc_id are documents of their own; a null doc_id ranks behind equal scores;
rows repeating an item_id are one item with all their terms; an item without known terms has
no rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm._kernels import SLICE_BYTES, U, Words, raw, sliced, word_hashes
from meterlake.llm._spark import over_arrow, shuffle_partitions, stage_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, BLOCK, ITEMS, TOP = 8 << 20, 128, 256, 20
BROADCAST_TERMS = 100_000  # rows of the query's terms, some 100 bytes each
OPEN = 16  # segments opened at first; then twice as many each time
INSIDE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
CAPITAL = np.array([np.uint8(32 if 65 <= b <= 90 else 0) for b in range(256)], np.uint8)

INDEX = "shard long, term string, df long, ends array<int>, peaks array<int>, heads array<int>, body binary, docs array<long>"


def term_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and document offsets of the texts, in pieces of about a slice that end between terms."""
    data, offsets = raw(texts)
    at = 0
    while at < len(data):
        to = min(at + 2 * SLICE_BYTES, len(data))
        while to < len(data) and INSIDE[data[to]]:  # never inside a term
            step = INSIDE[data[to : to + SLICE_BYTES]]
            to += len(step) if step.all() else int(np.argmin(step))
        yield data[at:to], np.clip(offsets, at, to) - at
        at = to


def split_terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased terms; a term ends at a text's end too."""
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data + CAPITAL[data], starts, ends - starts, np.searchsorted(starts, offsets))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for _, texts in sliced(batch):
            held = np.zeros(len(texts), np.int64)
            for data, offsets in _pieces(texts):
                held += np.diff(split_terms(data, offsets).bounds)
            n, total = n + int((held > 0).sum()), total + int(held.sum())
    yield pa.record_batch([pa.array([n]), pa.array([total])], ["n", "total"])


class Corpus(NamedTuple):
    documents: int  # with a term
    terms: int


def corpus_counts(docs: DataFrame) -> Corpus:
    got = over_arrow(docs.select("text"), _counts, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return Corpus(got[0] or 0, got[1] or 0)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each, the last byte below 128; and where each number ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= (1 << (7 * k))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    left, place = values.copy(), ends - size
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k + 1
        now = size > k
        out[place[now] + k] = (left[now] & 127) | (more[now].astype(np.int64) << 7)
        left >>= 7
    return out, ends


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(data)) - np.repeat(first, last - first + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Shard:
    """Postings of the documents read so far, by slices."""

    def __init__(self, corpus: Corpus) -> None:
        self.corpus, self.bytes, self.n = corpus, 0, 0
        self.ids, self.lengths, self.postings, self.names = [], [], [], []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        lengths = np.zeros(len(texts), np.int64)
        for data, offsets in _pieces(texts):
            words = split_terms(data, offsets)
            if not len(words.starts):
                continue
            hashes = word_hashes(words)
            doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            lengths += np.diff(words.bounds)
            order = np.argsort(hashes, kind="stable")  # documents stay in order
            h, d = hashes[order], doc[order]
            at = _runs(h, d)
            self.postings.append((h[at], (d[at] + self.n).astype(np.int32), np.diff(np.append(at, len(h))).astype(np.int32)))
            own = order[_runs(h)]
            size = words.lengths[own]
            heads = np.concatenate([[0], np.cumsum(size)])
            letters = words.data[np.arange(heads[-1]) - np.repeat(heads[:-1], size) + np.repeat(words.starts[own], size)]
            self.names.append((hashes[own], pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(heads), pa.py_buffer(letters)])))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.n += len(texts)
        self.bytes += len(raw(texts)[0])

    def close(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row with doc_id and m of each document, then a row a term."""
        n = np.concatenate(self.lengths)
        m = 75 + (25 * n * self.corpus.documents) // self.corpus.terms
        ids = pa.concat_arrays(self.ids)
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        docs = np.concatenate([m, ids.fill_null(0).to_numpy(), known])
        empty = lambda k: pa.nulls(k, pa.list_(pa.int32()))
        yield pa.record_batch([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([self.n]), empty(1), empty(1), empty(1), pa.nulls(1, pa.binary()), pa.array([docs], pa.list_(pa.int64()))], ["shard", "term", "df", "ends", "peaks", "heads", "body", "docs"])
        if not self.postings:
            return
        h, d, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        order = np.argsort(h, kind="stable")
        h, d, tf = h[order], d[order], tf[order].astype(np.int64)
        at = _runs(h, d)  # a long text comes in pieces
        tf, h, d = np.add.reduceat(tf, at), h[at], d[at].astype(np.int64)
        start = _runs(h)
        df = np.diff(np.append(start, len(h)))
        inner = np.arange(len(h)) - np.repeat(start, df)
        gap = np.where(inner == 0, d, d - np.concatenate([[0], d[:-1]]))
        body, stop = pack_numbers(np.stack([gap, tf], 1).ravel())
        stop = stop[1::2]
        begin = np.concatenate([[0], stop[:-1]])
        block = np.flatnonzero(inner % BLOCK == 0)
        blocks = -(-df // BLOCK)
        ends = d[np.append(block[1:], len(d)) - 1].astype(np.int32)
        peaks = np.maximum.reduceat(impact(tf, m[d]), block).astype(np.int32)
        heads = (begin[block] - np.repeat(begin[start], blocks)).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(blocks)])
        edges = np.append(begin[start], len(body))
        hashes, names = np.concatenate([x for x, _ in self.names]), pa.concat_arrays([x for _, x in self.names])
        _, first = np.unique(hashes, return_index=True)
        names = names.take(pa.array(first))
        for a in range(0, len(start), 4000):
            b = min(a + 4000, len(start))
            lists = [pa.ListArray.from_arrays(pa.array((bounds[a : b + 1] - bounds[a]).astype(np.int32)), pa.array(x[bounds[a] : bounds[b]])) for x in (ends, peaks, heads)]
            offsets = (edges[a : b + 1] - edges[a]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(body[edges[a] : edges[b]])])
            yield pa.record_batch([pa.array(np.full(b - a, shard)), names.slice(a, b - a).cast(pa.string()), pa.array(df[a:b]), *lists, packed, pa.nulls(b - a, pa.list_(pa.int64()))], ["shard", "term", "df", "ends", "peaks", "heads", "body", "docs"])


def _invert(corpus: tuple[int, int], shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, shard = TaskContext.get().partitionId(), 0, Shard(Corpus(*corpus))
        for batch in batches:
            for part, texts in sliced(batch):
                shard.add(part.column(0), texts)
                if shard.bytes >= shard_bytes:
                    yield from shard.close((task << 24) + nth)
                    nth, shard = nth + 1, Shard(Corpus(*corpus))
        if shard.n:
            yield from shard.close((task << 24) + nth)

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, Corpus]:
    """The shards' index tables over every row of doc_id and text, written once, and the corpus counts."""
    corpus = corpus_counts(docs)
    if not corpus.terms:
        return docs.sparkSession.createDataFrame([], INDEX), corpus
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return stage_table(over_arrow(rows, _invert(tuple(corpus), shard_bytes), INDEX), "index"), corpus


class Postings:
    """One term of a shard; blocks are decompressed when first asked for."""

    def __init__(self, row: dict) -> None:
        self.weight, self.ends, self.peaks = row["weight"], np.asarray(row["ends"]), np.asarray(row["peaks"], dtype=np.int64)
        self.heads, self.body = np.append(row["heads"], len(row["body"])), np.frombuffer(row["body"], np.uint8)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def open(self, blocks: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for b in blocks.tolist():
            if b not in self.held:
                pairs = unpack_numbers(self.body[self.heads[b] : self.heads[b + 1]]).reshape(-1, 2)
                docs = np.cumsum(pairs[:, 0]) + (int(self.ends[b - 1]) if b else 0)
                self.held[b] = docs, impact(pairs[:, 1], m[docs])
        got = [self.held[b] for b in blocks.tolist()]
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))


class Best:
    """The k best (score, doc_id, no doc_id) of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, (np.empty(0, np.int64),) * 3

    def threshold(self) -> int:
        """Lower scores can't enter; an equal one may, by its doc_id."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        every = [np.concatenate([a, b]) for a, b in zip(self.rows, (score, ids, unknown), strict=True)]
        order = np.lexsort((every[1], every[2], -every[0]))[: self.k]
        self.rows = tuple(x[order] for x in every)


def search_shard(terms: list[tuple[Postings, int]], docs: np.ndarray, best: Best) -> None:
    """Adds the shard's best documents for one item; ``terms`` with their counts in the item."""
    m, ids, known = docs.reshape(3, -1)
    factors = [p.weight * n for p, n in terms]
    edges = np.unique(np.concatenate([p.ends for p, _ in terms]))
    bound, blocks = np.zeros(len(edges), np.int64), []
    for (p, _), f in zip(terms, factors, strict=True):
        at = np.searchsorted(p.ends, edges)
        inside = at < len(p.ends)
        bound[inside] += f * p.peaks[at[inside]]
        blocks.append(np.where(inside, at, -1))
    order, done, most = np.argsort(-bound, kind="stable"), 0, OPEN
    while done < len(order) and bound[order[done]] >= best.threshold():
        chosen = order[done : done + most]
        chosen = chosen[bound[chosen] >= best.threshold()]
        done, most = done + len(chosen), 2 * most
        opened = np.zeros(len(edges) + 1, bool)
        opened[chosen] = True
        score = np.zeros(len(m), np.int64)
        for (p, _), f, b in zip(terms, factors, blocks, strict=True):
            wanted = np.unique(b[chosen])
            wanted = wanted[wanted >= 0]
            if len(wanted):
                d, s = p.open(wanted, m)
                score[d] += f * s
        found = np.flatnonzero(score >= best.threshold())
        found = found[opened[np.searchsorted(edges, found)]]  # scores are whole in opened segments only
        best.add(score[found], ids[found], 1 - known[found])


def _search(k: int):
    def flush(best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
        for code, b in best.items():
            score, ids, unknown = b.rows
            yield pa.record_batch([pa.array(np.full(len(ids), code)), pa.array(ids, mask=unknown.astype(bool)), pa.array(score)], ["code", "doc_id", "score"])

    def one(rows: list[dict], best: dict[int, Best]) -> None:
        docs = next((np.asarray(r["docs"]) for r in rows if r["term"] is None), None)
        items: dict[int, list[tuple[Postings, int]]] = {}
        for r in rows:
            if r["term"] is not None:
                p = Postings(r)
                for code, n in zip(r["codes"], r["times"], strict=True):
                    items.setdefault(code, []).append((p, n))
        for code, terms in items.items():
            search_shard(terms, docs, best.setdefault(code, Best(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, best = None, [], {}
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["part"], r["shard"])) != key:
                    if rows:
                        one(rows, best)
                    if key is not None and now[0] != key[0]:
                        yield from flush(best)
                        best = {}
                    key, rows = now, []
                rows.append(r)
        if rows:
            one(rows, best)
        yield from flush(best)

    return run


def item_terms(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(code, key) of each item, and (code, term, times)."""
    codes = items.select(key).distinct().coalesce(shuffle_partitions(items.sparkSession)).withColumn("code", F.monotonically_increasing_id())
    codes = stage_table(codes.select("code", key), "items")
    each = items.select(key, F.explode(term_array(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))
    renamed = each.withColumnRenamed(key, "__key")
    terms = codes.join(renamed, F.col(key).eqNullSafe(F.col("__key"))).select("code", "term", "times")
    return codes, stage_table(terms, "terms")


def search(index: DataFrame, corpus: Corpus, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """key, rank, doc_id and score of each item's ``k`` best documents."""
    spark = index.sparkSession
    codes, terms = item_terms(items, key, text)
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_TERMS else df
    wanted = stage_table(terms.select("term").distinct(), "wanted")
    n_terms, parts = wanted.count(), max(1, -(-codes.count() // ITEMS))
    found = stage_table(index.where("term is not null").join(small(wanted, n_terms), "term"), "postings")
    df = found.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.log(F.lit(float(2 * corpus.documents + 2)) / (F.lit(2) * F.col("df") + 1)) * 1000).cast("long")
    part = F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")
    asked = terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0").groupBy(part.alias("part"), "term", "weight").agg(F.collect_list("code").alias("codes"), F.collect_list("times").alias("times"))
    asked = stage_table(asked, "asked")
    posted = found.drop("df", "docs").join(small(asked, asked.count()), "term").withColumn("docs", F.lit(None).cast("array<long>"))
    tables = index.where("term is null").select("shard", "docs").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = posted.unionByName(tables, allowMissingColumns=True)
    dealt = rows.repartition(shuffle_partitions(spark), "part", "shard").sortWithinPartitions("part", "shard")
    best = over_arrow(dealt, _search(k), "code long, doc_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(small(codes, codes.count()), "code").select(key, "rank", "doc_id", "score")


def oracle(k: int = TOP) -> str:
    terms = lambda c: rf"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms("text")} AS ts FROM documents),
t AS (SELECT r, unnest(ts) AS term FROM d), tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
c AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::bigint AS l FROM d),
m AS (SELECT r, doc_id, 75 + (25 * len(ts) * n) // l AS m FROM d, c WHERE l > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(ln((2 * n + 2) / (2 * df + 1)) * 1000)::bigint AS w FROM df, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r
), x AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM x WHERE rank <= {k}
"""
