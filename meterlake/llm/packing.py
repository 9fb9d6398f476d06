"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue: its documents in a hashed block order, token after token. Time
runs in quanta of 256 tokens, 8 to a window of 2048. After x quanta in all, queue q has
been served c_q(x) of its own, fixed by halving the ordered queues again and again and
giving the left half ``floor(amount * left / both)``: c_q never falls, the queues' shares
add up to x exactly, and each differs from its target by less than one quantum for each
halving. That difference is the queue's deficit; it is carried from window to window, and
as c_q(x) is a closed form of the queue totals alone, any task can cut any document
without knowing the others. So every window holds the target proportions, and only the
last quantum of each queue and the last window can be short.

The target is the queues' own totals, or the ``weights`` given: then windows hold those
until the first queue is empty, the others' weights from there, and so on, phase by phase.

Tokens are those of the byte-level vocabulary of 50,257 entries, read from its rank file
by tiktoken, four times as fast as from the JSON file; the added tokens are read from the
JSON file, so the ids equal its ids (see the tests). One end id follows.

A block holds about 16 MB of text, and a 65,536th of all text at least, so blocks grow in
number with their source and the plan stays small. Beyond ``MAX_QUEUES`` sources, sources
share that many queues by hash; in a shared queue their documents stand in hashed order,
so they follow their proportions on average.

Defined cases: null text is empty and still yields its end id; a null source is the queue
''; repeated rows are packed once for each row; an empty table gives no pieces; weights
must be positive and name every source.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import _kernels as K
from meterlake.llm._spark import over_arrow, stage_table

LENGTH, QUANTUM, END_ID = 2048, 256, 1
PER_WINDOW = LENGTH // QUANTUM
BLOCK_BYTES, BLOCKS, MAX_QUEUES = 16 << 20, 65_536, 100_000
TOKENIZER, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encoder(path: str | None = None, added: str | None = None):
    """The tokenizer of a rank file (each line a base64 token and its id) and of the added tokens of a JSON file."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as file:
        ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}
    with open(added or public_tokenizers.path(ADDED), encoding="utf-8") as file:
        special = json.load(file)["added_tokens"]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in special):
        raise ValueError("added tokens that take the space around them are not supported")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in special})


def _tokenize(path: str | None, added: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added).encode_to_numpy
        for batch in batches:
            for rows, texts in K.sliced(batch):
                ids = [np.append(encode(t, allowed_special="all"), END_ID).astype("<u2") for t in texts.to_pylist()]
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), rows.column(2), rows.column(4), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "queue", "block", "order", "n", "ids"],
                )

    return run


def share(x: np.ndarray, part: np.ndarray | int, whole: np.ndarray | int) -> np.ndarray:
    """floor(x * part / whole), exact for values below 2**40."""
    high, low = x >> 20, x & ((1 << 20) - 1)
    first = high * part
    return ((first // whole) << 20) + ((first % whole << 20) + low * part) // whole


class Plan:
    """What each queue has been served after any number of quanta; all methods take arrays."""

    def __init__(self, totals: list[int], weights: list[float] | None = None) -> None:
        self.tokens = np.array(totals, np.int64)
        self.quanta = -(-self.tokens // QUANTUM)
        steps = self._phases(weights)  # quanta of each queue in each phase
        n = len(self.quanta)
        self.sums = np.concatenate([np.zeros((len(steps), 1), np.int64), np.cumsum(steps, axis=1)], axis=1)
        self.begin = np.concatenate([[0], np.cumsum(steps.sum(axis=1))])
        self.base = np.concatenate([np.zeros((1, n), np.int64), np.cumsum(steps, axis=0)])[:-1]
        self.base_before = np.concatenate([np.zeros((len(steps), 1), np.int64), np.cumsum(self.base, axis=1)], axis=1)
        # how much the last quanta of the queues before q fall short, by the window they lie in
        short = self.quanta * QUANTUM - self.tokens
        last = self.window(np.arange(n), self.quanta - 1)
        order = np.lexsort((np.arange(n), last))
        self.ends = (last * n + np.arange(n))[order]
        self.gaps = np.concatenate([[0], np.cumsum(short[order])])

    @classmethod
    def of(cls, served: dict[str, np.ndarray]) -> Plan:
        """The plan of ``vars(plan)``, which workers can be sent before they know the package."""
        plan = cls.__new__(cls)
        vars(plan).update(served)
        return plan

    def _phases(self, weights: list[float] | None) -> np.ndarray:
        if weights is None:
            return self.quanta[None, :].copy()
        until = self.quanta / np.array(weights, float)
        done, steps = np.zeros_like(self.quanta), []
        for t in np.unique(until):
            upto = np.where(until <= t, self.quanta, np.minimum(np.floor(t * np.array(weights)).astype(np.int64), self.quanta))
            steps.append(np.maximum(upto, done) - done)
            done = np.maximum(upto, done)
        return np.array(steps, np.int64).reshape(-1, len(self.quanta))

    def served(self, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quanta of the queues before q, and of q, among the first x."""
        x = np.minimum(x, self.begin[-1])
        phase = np.clip(np.searchsorted(self.begin, x, "right") - 1, 0, len(self.sums) - 1)
        x = x - self.begin[phase]
        lo, hi, before = np.zeros_like(x), np.full_like(x, len(self.quanta)), np.zeros_like(x)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            whole = self.sums[phase, hi] - self.sums[phase, lo]
            left = share(x, self.sums[phase, mid] - self.sums[phase, lo], np.maximum(whole, 1))
            some, goes = hi - lo > 1, q < mid
            before = np.where(some & ~goes, before + left, before)
            x = np.where(some, np.where(goes, left, x - left), x)
            lo, hi = np.where(some & ~goes, mid, lo), np.where(some & goes, mid, hi)
        return self.base_before[phase, q] + before, self.base[phase, q] + x

    def window(self, q: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """The window that serves each quantum of q."""
        lo = np.zeros_like(quantum)
        hi = np.full_like(quantum, self.begin[-1] // PER_WINDOW + 1)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            past = self.served(q, (mid + 1) * PER_WINDOW)[1] > quantum
            hi, lo = np.where(past, mid, hi), np.where(past, lo, mid + 1)
        return lo

    def missing(self, q: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Tokens that the queues before q fall short of in the window."""
        n = len(self.quanta)
        a, b = np.searchsorted(self.ends, window * n), np.searchsorted(self.ends, window * n + q)
        return self.gaps[b] - self.gaps[a]

    def cut(self, q: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents at token ``starts`` of queues q: document, start in it, length, window, offset."""
        first, last = starts // QUANTUM, (starts + sizes - 1) // QUANTUM
        n = last - first + 1
        doc = np.repeat(np.arange(len(starts)), n)
        unit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        window = self.window(q[doc], unit)
        head = np.ones(len(unit), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
        at = np.flatnonzero(head)
        end = np.append(at[1:], len(unit)) - 1
        d, w = doc[at], window[at]
        a = np.maximum(unit[at] * QUANTUM, starts[d])
        b = np.minimum((unit[end] + 1) * QUANTUM, starts[d] + sizes[d])
        before0, own0 = self.served(q[d], w * PER_WINDOW)
        before1, _ = self.served(q[d], (w + 1) * PER_WINDOW)
        offset = (before1 - before0) * QUANTUM + a - own0 * QUANTUM - self.missing(q[d], w)
        return d, a - starts[d], b - a, w, offset


def _cut(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        served, keys, begins = held.value
        plan = Plan.of(served)
        for batch in batches:
            if not len(batch):
                continue
            queue, block, at, sizes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
            begin = begins[np.searchsorted(keys, queue * BLOCKS + block)] + at
            step = max(1, (1 << 20) // max(1, int(sizes.mean())))
            for i in range(0, len(batch), step):
                some = slice(i, i + step)
                doc, start, length, window, offset = plan.cut(queue[some], begin[some], sizes[some])
                ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(5).slice(i, step)]).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(doc + i)), pa.array(start), pa.array(length), body.cast(pa.binary()), pa.array(sizes[some][doc]), pa.array(window), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str, float] | None = None, added: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of ``docs(doc_id, text, source)``.

    ``ids`` are little-endian unsigned 32-bit. ``weights`` gives each source's share of a window.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    if docs.select(source.alias("s")).distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        if weights is not None:
            raise ValueError(f"weights take up to {MAX_QUEUES} sources")
        source = F.pmod(F.xxhash64(source), F.lit(MAX_QUEUES)).cast("string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    found = docs.select(source.alias("s"), size.alias("b")).groupBy("s").agg(F.sum("b").alias("b")).collect()  # at most MAX_QUEUES rows
    found = sorted((r["s"], r["b"]) for r in found)
    least = max(BLOCK_BYTES, sum(b for _, b in found) // (BLOCKS - 1) + 1)
    queues = spark.createDataFrame([(s, i, -(-b // least)) for i, (s, b) in enumerate(found)], "__s string, queue int, blocks long")
    rows = docs.select("doc_id", source.alias("__s"), "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("order")).join(F.broadcast(queues), "__s")
    rows = rows.select("doc_id", "queue", F.pmod("order", "blocks").cast("int").alias("block"), "text", "order")
    tokens = rows.transform(over_arrow, _tokenize(tokenizer, added), "doc_id long, queue int, block int, order long, n long, ids binary")
    before = Window.partitionBy("queue", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tokens.select("doc_id", "queue", "block", (F.sum("n").over(before) - F.col("n")).alias("at"), "n", "ids")
    placed = stage_table(placed, "tokens")
    sums = placed.groupBy("queue", "block").agg(F.sum("n").alias("n")).collect()  # at most BLOCKS + MAX_QUEUES rows
    sums = sorted((r["queue"], r["block"], r["n"]) for r in sums)
    if not sums:
        return placed.selectExpr("doc_id", "0L AS start", "n AS length", "ids", "n AS doc_tokens", "0L AS sequence_id", "at AS offset")
    queue, block, n = (np.array(x, np.int64) for x in zip(*sums, strict=True))
    totals = np.bincount(queue, n, len(found)).astype(np.int64)
    first = np.searchsorted(queue, np.arange(len(found)))
    upto = np.cumsum(n) - n
    plan = Plan(totals.tolist(), None if weights is None else [weights[s] for s, _ in found])
    held = spark.sparkContext.broadcast((vars(plan), queue * BLOCKS + block, upto - upto[first][queue]))
    return placed.transform(over_arrow, _cut(held), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
