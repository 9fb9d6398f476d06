"""Filter interaction audit by signed parity sums.

Each document fails a subset of the filters, a mask of bits. For every part and label the
aggregate holds, for each set S of filters, the sum over documents of -1 to the power of
the number of failed filters in S. These 2**k sums are the Walsh-Hadamard transform of the
counts by mask, so they invert exactly to those counts, and all orders of the filters are
evaluated from the counts without another look at the documents. A document that fails f
filters is removed first by each of them in k!/f orders, which sums a filter's removals
over all orders in closed form.

The texts are read once, into narrow rows. A text's first document is found by one grouping
of digests and joined back on digest and doc_id, so that a text with any number of copies
spreads over all tasks. Sums are taken before rows move, whatever the size of a part.

Defined cases: a null text is the empty text, a null part the empty string; rows without
doc_id never repeat a smaller one and have no labels; rows repeating the least doc_id of
their text repeat nothing; several labels of one doc_id count where any is 1; documents
without labels are neither good nor toxic; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm._spark import over_arrow, stage_table

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SIGNS = "[#$%&*|]"
CLASSES = ("all", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(SIGNS),
    }


def mask_of(failures: list[Column]) -> Column:
    """Bit i is set where the i-th filter fails."""
    total = F.lit(0)
    for i, fails in enumerate(failures):
        total = total + F.when(fails, 1 << i).otherwise(0)
    return total.cast("int")


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of each document: filters A to D by its text, E by all texts."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask_of(list(text_filters(text).values())).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = stage_table(own, "audit")
    first = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = own.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    known = known.select("part", (F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)).alias("mask"), zero("good"), zero("toxic"))
    return known.unionByName(own.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def parity_sums(rows: DataFrame, filters: int) -> DataFrame:
    """part, and for each class an array of 2**filters signed sums over part, mask, good, toxic."""
    sets = range(1 << filters)
    classes = F.array(F.lit(0), F.when(F.col("good") == 1, 1), F.when(F.col("toxic") == 1, 2))
    each = rows.select("part", "mask", F.explode(F.array_compact(classes)).alias("class"))
    sign = lambda s: F.lit(1) - (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2) * 2
    sums = each.groupBy("part", "class").agg(*[F.sum(sign(s)).cast("long").alias(f"s{s}") for s in sets])
    table = sums.select("part", "class", F.array(*[f"s{s}" for s in sets]).alias("sums"))
    none = F.array(*[F.lit(0).cast("long") for _ in sets])
    of = lambda c: F.coalesce(F.max(F.when(F.col("class") == c, F.col("sums"))), none)
    return table.groupBy("part").agg(*[of(c).alias(name) for c, name in enumerate(CLASSES)])


def hadamard(filters: int) -> np.ndarray:
    n = np.arange(1 << filters)
    return 1 - 2 * (np.bitwise_count(n[:, None] & n[None, :]).astype(np.int64) % 2)


def invert(sums: np.ndarray, filters: int) -> np.ndarray:
    """Counts by mask from signed sums along the last axis; exact in integers."""
    return (sums @ hadamard(filters)) >> filters


def order_steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Order, step, bit of the step's filter and mask of the filters before it."""
    names, steps, bits, before = [], [], [], []
    for order in permutations(letters):
        gone = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            names.append("".join(order))
            steps.append(step)
            bits.append(bit)
            before.append(gone)
            gone |= bit
    return names, np.array(steps), np.array(bits), np.array(before)


def _evaluate(letters: str):
    k = len(letters)
    names, steps, bits, before = order_steps(letters)
    masks = np.arange(1 << k)
    fails, earlier = (masks & bits[:, None]) != 0, (masks & before[:, None]) != 0
    share = np.array([0] + [factorial(k) // int(n) if factorial(k) % int(n) == 0 else 0 for n in np.bitwise_count(masks[1:])], np.int64)
    weights = [~fails & ~earlier, fails & ~earlier, fails & earlier, masks == bits[:, None], fails & ~earlier, fails & ~earlier, fails * share]
    source = (0, 0, 0, 0, 1, 2, 0)  # which class a count is taken from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cells = [invert(batch.column(c)[i].values.to_numpy(), k) for c in range(1, 4)]
                counts = [pa.array(w.astype(np.int64) @ cells[c]) for w, c in zip(weights, source, strict=True)]
                part = pa.array([batch.column(0)[i].as_py()] * len(names), pa.string())
                yield pa.record_batch([part, pa.array(names), pa.array(steps, pa.int32()), *counts], ["part", "filter_order", "step", *COUNTS])

    return run


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """Counts of every order and step from part, mask, good and toxic of each document.

    Bit i of a mask stands for letter i; up to six filters, whose orders make 4,320 rows a part.
    """
    if not 1 <= len(letters) <= 6 or len(set(letters)) < len(letters):
        raise ValueError("one to six different letters")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return over_arrow(parity_sums(rows, len(letters)), _evaluate(letters), schema)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failing(docs, labels), "ABCDE")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {{'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '{SIGNS}'), 'E': coalesce(first < doc_id, false)}} AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS letter, n, good, toxic, fails[o[step]] AS bad,
    len(list_filter(o[:step - 1], lambda y: fails[y])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) = 1 AS single
  FROM c, s
), a AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0)::bigint AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (WHERE bad AND gone), 0)::bigint AS redundant, coalesce(sum(n) FILTER (WHERE bad AND single), 0)::bigint AS unique_fails,
    coalesce(sum(n) FILTER (WHERE bad AND NOT gone AND good = 1), 0)::bigint AS good_lost, coalesce(sum(n) FILTER (WHERE bad AND NOT gone AND toxic = 1), 0)::bigint AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM a
"""
