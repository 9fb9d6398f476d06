"""MinHash near-dedup: SuperMinHash signatures, banding, full verification, union-find.

Texts are lower-cased (A-Z) and cut into words; the set of a text is its distinct
five-word shingles. Equal sets are first collapsed to one representative, so groups
of copies cost one row each in all later steps. Buckets with the same members count once.

Representatives meet in buckets of four signature lanes, and the least member of a bucket
is its pivot. Each document is first compared with the pivot that it meets in most buckets.
The links found make components, and only pairs of a document and another of its pivots
that lie in different components are compared next: within a group of near copies nearly
all of them fall away, so every document moves about once. What is still apart from a
pivot of its is compared with all members of that bucket that are in another component;
where these are few the pairs are listed, each once over all buckets.

Every comparison is exact, on the full sets, and works by cells: both sides of a bucket are
dealt into blocks of bounded size, each block meets each of the other side in one cell, and
a cell counts the common shingles of all its pairs at once. A cell gives at most one link
for each component in it. So the only loss is the banding's: a pair at similarity 0.75
shares no bucket with probability 2e-5.

Defined cases: a null, empty or wordless text has an empty set and links with nothing;
rows repeating a doc_id are one document, linked by each of their texts; a null doc_id
links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import _kernels as K
from meterlake.llm._graph import components, union_find
from meterlake.llm._spark import over_arrow, stage_table

LANES, ROWS = 112, 4
BANDS = LANES // ROWS
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19  # of a side of a cell, about (a larger set stands alone)
COLUMNS = 4096  # shingles counted at once
BROADCAST_ROWS = 200_000  # 32 bytes each
SALTS = 16
PAIRS = 4  # rows of pairs for each row that a bucket has in a cell, at most
U = np.uint64


def superminhash(elements: np.ndarray, owner: np.ndarray, count: int, lanes: int = LANES) -> np.ndarray:
    """SuperMinHash signatures of ``count`` sets at once; empty sets keep the largest value.

    In round j every element draws a value in [j, j + 1) and the j-th entry of its own
    random permutation of the lanes (drawn step by step), and offers the value to that
    lane. When all lanes of a set are filled, later rounds cannot lower any of them, so
    its elements leave. Values hold j in the top 16 bits and 48 random bits below.
    """
    sig = np.full(count * lanes, np.iinfo(U).max, U)
    perm = None
    for j in range(lanes):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            drawn = K.mix(elements + U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((drawn & U(0xFFFF)) * U(lanes - j)) >> U(16)).astype(np.int64)
        if perm is None:
            lane = pick
        else:
            each = np.arange(len(elements))
            lane = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[:, j]
        np.minimum.at(sig, owner * lanes + lane, (U(j) << U(48)) | (drawn >> U(16)))
        unfilled = (sig.reshape(count, lanes) == np.iinfo(U).max).any(axis=1)
        stay = unfilled[owner]
        if perm is None:
            perm = np.tile(np.arange(lanes, dtype=np.uint8), (int(stay.sum()), 1))
            perm[np.arange(len(perm)), pick[stay]] = 0
        else:
            perm = perm[stay]
        elements, owner = elements[stay], owner[stay]
    return sig.reshape(count, lanes)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seed = K.randoms(LANES, 11)
    for batch in batches:
        for rows, texts in K.sliced(batch):
            hashes, bounds = K.shingle_sets(texts)
            n, sizes = len(texts), np.diff(bounds)
            owner = np.repeat(np.arange(n), sizes)
            sig = superminhash(hashes, owner, n)
            with np.errstate(over="ignore"):
                keys = K.mix((K.mix(sig.reshape(-1)).reshape(n, LANES) * seed).reshape(n, BANDS, ROWS).sum(axis=2, dtype=U).reshape(-1))
                prints = []
                for k in (3, 5):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(hashes * U(2 * k + 1) + U(k)))])
                    prints.append(sums[bounds[1:]] - sums[bounds[:-1]])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), K.as_long(keys))
            yield pa.record_batch([rows.column(0), pa.array(sizes, pa.int64()), K.as_long(prints[0]), K.as_long(prints[1]), bands], ["doc_id", "n_shingles", "p0", "p1", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted hashes of each text's set, as bytes."""
    for batch in batches:
        for rows, texts in K.sliced(batch):
            hashes, bounds = K.shingle_sets(texts)
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds * 8), pa.py_buffer(np.ascontiguousarray(hashes))])
            yield pa.record_batch([rows.column(0), body.cast(pa.binary())], ["d", "shingles"])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set of distinct hashes."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    if len(left) <= 4:
        out = np.zeros((len(left), len(right)), np.int64)
        for i, own in enumerate(left):
            out[i] = np.bincount(rows[1][np.isin(flat[1], own)], minlength=len(right))
        return out
    shared = np.intersect1d(flat[0], flat[1])
    cells = []
    for one, row in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(shared, one), max(0, len(shared) - 1))
        hit = shared[at] == one if len(shared) else np.zeros(len(one), bool)
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        cells.append((at[order], row[order]))
    total = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, len(shared), COLUMNS):
        dense = []
        for (at, row), n in zip(cells, sizes, strict=True):
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            held = np.zeros((len(n), COLUMNS), np.float32)
            held[row[a:b], at[a:b] - first] = 1
            dense.append(held)
        total += (dense[0] @ dense[1].T).astype(np.int64)  # below 2**24, hence exact
    return total


def _meet(num: int, den: int):
    """Rows (k, i, j, side, d, c, shingles), sorted by cell (k, i, j): links (u, v) of components c.

    The sets of side 1 meet those of side 0 that are in another component.
    """

    def cell(side: np.ndarray, c: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(one) or not len(two):
            return None
        both = common([sets[i] for i in one], [sets[i] for i in two])
        n = np.array([len(x) for x in sets], np.int64)
        either = n[one][:, None] + n[two][None, :] - both
        a, b = np.nonzero((both * den >= either * num) & (c[one][:, None] != c[two][None, :]))
        if not len(a):
            return None
        node, root = union_find(c[one][a], c[two][b])
        link = node != root
        return pa.record_batch([pa.array(node[link]), pa.array(root[link])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                side, c = (np.concatenate([h[x] for h in held]) for x in (0, 1))
                if (made := cell(side, c, [s for h in held for s in h[2]])) is not None:
                    yield made

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(3)], axis=1)
            side, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in (3, 5))
            data, offsets = K.raw(batch.column(6).cast(pa.large_binary()))
            bounds = offsets // 8
            hashes = np.frombuffer(data.tobytes(), U)
            sets = [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (at := tuple(key[a])) != last:
                    yield from flush()
                    last, held = at, []
                held.append((side[a:b], c[a:b], sets[a:b]))
        yield from flush()

    return run


def _blocks(count: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(count / BLOCK_ROWS, shingles / BLOCK_SHINGLES, F.lit(1.0))).cast("long")


def _whole(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _mine(n: str) -> Column:
    return F.array(F.pmod(F.xxhash64("d", F.lit(n)), F.col(n)))


def _representatives(some: DataFrame) -> DataFrame:
    """``some`` and the least doc_id ``rep`` with the same set, where another row has it too."""
    print_ = ["n_shingles", "p0", "p1"]
    first = some.groupBy(*print_).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = stage_table(first, "repeated")
    if first.count() <= BROADCAST_ROWS:
        return some.join(F.broadcast(first), print_, "left")
    # a set may be that of a third of all rows: dealt by salt
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return some.withColumn("salt", salt).join(first, [*print_, "salt"], "left").drop("salt")


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text, ...)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stage_table(texts.transform(over_arrow, _sketch, "doc_id long, n_shingles long, p0 long, p1 long, bands array<long>"), "sketches")
    found = _representatives(sketches.where("n_shingles > 0 and doc_id is not null"))
    copies = found.where("rep < doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    members = found.where("rep is null or rep = doc_id").select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))

    # buckets with the same members count once, with their number as weight; members move once, and those alone in a bucket go no further
    mark, bucket = F.xxhash64("d"), Window.partitionBy("key")
    counted = members.withColumns({"size": F.count("*").over(bucket), "pivot": F.min("d").over(bucket), "whole": F.sum("n").over(bucket), "m0": F.bit_xor(mark).over(bucket), "m1": F.sum(F.shiftrightunsigned(mark, 24)).over(bucket)})
    met = stage_table(counted.where("size > 1"), "met")
    same = ["pivot", "size", "whole", "m0", "m1"]
    shared = met.where("d = pivot").groupBy(*same).agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    met = stage_table(met.drop(*same).join(shared, "key").select("key", "pivot", "size", "weight", "d", "n"), "members")
    wanted = stage_table(met.select(F.col("d").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = stage_table(texts.join(wanted, "doc_id", "left_semi").transform(over_arrow, _sets, "d long, shingles binary"), "sets")

    def marked(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        """rows(d, ...) with the component c of each d."""
        if comps is None:
            return rows.withColumn("c", F.col("d"))
        known = comps.select(F.col("node").alias("d"), F.col("component").alias("c"))
        return rows.join(known, "d", "left").withColumn("c", F.coalesce("c", "d"))

    def linked(cells: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Links between the components of cells(k, i, j, side, d)."""
        rows = marked(cells, comps).join(sets, "d").select("k", "i", "j", "side", "d", "c", "shingles")
        ordered = rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
        return stage_table(ordered.transform(over_arrow, _meet(num, den), "u long, v long"), "links")

    def stars(pairs: DataFrame) -> DataFrame:
        """Cells in which each pivot meets the documents of its pairs(pivot, d, n)."""
        hubs = pairs.groupBy("pivot").agg(_blocks(F.count("*"), F.sum("n")).alias("n_j"))
        one = hubs.select(F.col("pivot").alias("k"), F.explode(_whole("n_j")).alias("j"), F.lit(1).alias("side"), F.col("pivot").alias("d"))
        two = pairs.join(hubs, "pivot").select(F.col("pivot").alias("k"), F.explode(_mine("n_j")).alias("j"), F.lit(0).alias("side"), "d")
        return one.union(two).select("k", F.lit(0).cast("long").alias("i"), "j", "side", "d")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """The pairs(pivot, d, ...) whose ends lie in different components."""
        hubs = comps.select(F.col("node").alias("pivot"), F.col("component").alias("cp"))
        both = marked(pairs, comps).join(hubs, "pivot", "left")
        return both.where(F.coalesce("cp", "pivot") != F.col("c")).drop("c", "cp")

    votes = met.where("d > pivot").groupBy("pivot", "d").agg(F.sum("weight").alias("v"), F.max("n").alias("n"))
    votes = stage_table(votes, "votes")
    chosen = votes.groupBy("d").agg(F.max_by(F.struct("pivot", "n"), F.struct("v", -F.col("pivot"))).alias("x")).select("d", "x.pivot", "x.n")
    chosen = stage_table(chosen, "chosen")
    links = linked(stars(chosen), None)
    comps = components(links)
    others = apart(votes.select("pivot", "d", "n").join(chosen.select("pivot", "d"), ["pivot", "d"], "left_anti"), comps)
    links = links.union(linked(stars(stage_table(others, "others")), comps))

    # members in another component than their bucket's pivot meet all other members of it but the pivot, which they have met
    comps = components(links)
    hubs = comps.select(F.col("node").alias("pivot"), F.col("component").alias("cp"))
    rest = marked(met.where("size > 2 and d > pivot"), comps).join(hubs, "pivot", "left")
    rest = stage_table(rest.select("key", "d", "n", "c", (F.coalesce("cp", "pivot") != F.col("c")).alias("far")), "rest")
    held = rest.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("whole"), F.count_if("far").alias("s"), F.sum(F.when(F.col("far"), F.col("n"))).alias("own"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    held = stage_table(held.where("s > 0 and c0 < c1").select("key", "s", "m", "own", "whole"), "held")
    few = F.col("s") * F.col("m") <= PAIRS * (F.col("s") + F.col("m"))

    # in most buckets they are few: a pair counts once over all buckets, and only where the sizes of its sets allow a link
    side = lambda x: [F.col(c).alias(x + c) for c in ("d", "n", "c")]
    near = rest.join(held.where(few).select("key"), "key")
    pairs = near.where("far").select("key", *side("a")).join(near.select("key", *side("b")), "key").where("ac <> bc").where((F.col("an") * den >= F.col("bn") * num) & (F.col("bn") * den >= F.col("an") * num))
    pairs = pairs.select(F.least("ad", "bd").alias("pivot"), F.greatest("ad", "bd").alias("d"), F.when(F.col("ad") < F.col("bd"), F.col("bn")).otherwise(F.col("an")).alias("n")).distinct()

    # in the others they are dealt into blocks (cells of both kinds may go by one number, which adds comparisons and takes none)
    dealt = held.where(~few).select("key", _blocks(F.col("s"), F.col("own")).alias("n_i"), _blocks(F.col("m"), F.col("whole")).alias("n_j"))
    one = rest.where("far").join(dealt, "key").select("key", F.explode(_mine("n_i")).alias("i"), "n_j", F.lit(1).alias("side"), "d")
    one = one.select("key", "i", F.explode(_whole("n_j")).alias("j"), "side", "d")
    two = rest.join(dealt, "key").select("key", F.explode(_mine("n_j")).alias("j"), "n_i", F.lit(0).alias("side"), "d")
    two = two.select("key", F.explode(_whole("n_i")).alias("i"), "j", "side", "d")
    links = links.union(linked(stars(stage_table(pairs, "pairs")).union(one.union(two)), comps))

    comps = components(links.union(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(comps, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
