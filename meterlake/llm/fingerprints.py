"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A paragraph (line) has a fixed vector of 80 lanes:

* 16 lanes of 40 bits, hashed from the whole paragraph under 16 seeds;
* 64 lanes of 32 bits: each run of three words of the paragraph adds 1 or -1, by its
  hash, to the lane that its hash names.

A text's fingerprint is the sum of its paragraphs' vectors, each lane modulo its power of
two. Order does not matter; inserting or deleting a paragraph adds or subtracts its vector
(:func:`combine`). The first 640 bits decide equality. The other lanes are a linear sketch
of the multiset of runs, so the cosine of two texts' lanes estimates the likeness of their
multisets, with a standard deviation of about 0.12.

Lanes are summed as rows (text, lane, value) with map-side combining, not as wide
aggregates, whose generated code is too large to be compiled.

Defined cases: a null text is empty; an empty text is one empty paragraph and has no runs
(likeness 1 to an equal text, 0 to others); paragraphs of one or two words are one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS, LANES, RUN = 16, 64, 3
WIDE, NARROW = 1 << 40, 1 << 32


def _runs(paragraph: Column) -> Column:
    """Hashes of the runs of three words of a paragraph: the words zipped with themselves."""
    words = F.split(paragraph, " ", -1)
    count = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, count), lambda a, b: F.xxhash64(a, b))
    some = F.slice(F.zip_with(pairs, F.slice(words, 3, count), lambda h, c: F.xxhash64(h, c)), 1, F.greatest(count - (RUN - 1), F.lit(0)))
    return F.when(count >= RUN, some).when(paragraph != "", F.array(F.xxhash64(F.lit(RUN), paragraph))).otherwise(F.array().cast("array<bigint>"))


def vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the array ``lanes`` of each text."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("p"))
    seeds = F.array(*[F.xxhash64(F.lit(1000 + k), F.col("p")) for k in range(SEEDS)])
    units = paragraphs.select(*keys, F.posexplode(F.concat(seeds, _runs(F.col("p")))).alias("i", "h"))
    whole = F.col("i") < SEEDS
    lane = F.when(whole, F.col("i")).otherwise(SEEDS + F.col("h").bitwiseAND(F.lit(LANES - 1)).cast("int"))
    value = F.when(whole, F.col("h").bitwiseAND(F.lit(WIDE - 1))).otherwise(F.shiftright("h", 6).bitwiseAND(F.lit(1)) * 2 - 1)
    sums = units.select(*keys, lane.alias("lane"), value.alias("v")).groupBy(*keys, "lane").agg(F.sum("v").alias("v"))
    found = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lane", "v"))).alias("m"))
    get = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    lanes = F.transform(F.sequence(F.lit(0), F.lit(SEEDS + LANES - 1)), lambda i: F.pmod(get(i), F.when(i < SEEDS, WIDE).otherwise(NARROW)))
    return found.select(*keys, lanes.alias("lanes"))


def combine(a: str, b: str, sign: int = 1) -> Column:
    """The lanes after inserting (or with sign -1 deleting) the paragraphs of ``b``."""
    both = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(both, lambda x, i: F.pmod(x, F.when(i < SEEDS, WIDE).otherwise(NARROW)))


def text_form(lanes: str) -> Column:
    """A fingerprint as text, ten or eight hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < SEEDS, 10).otherwise(8), F.lit("0")))), "")


def likeness(a: str, b: str) -> Column:
    """Estimate, 0 to 1, from two fingerprints alone; 1 where all lanes are equal."""

    def signed(lanes: str) -> Column:
        return F.transform(F.slice(lanes, SEEDS + 1, LANES), lambda x: F.when(x >= NARROW // 2, x - NARROW).otherwise(x).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)

    x, y = signed(a), signed(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, dot(x, y) / size).otherwise(0.0)
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """1 + the number of cuts below doc_id, by bisection; 0 for null."""
    array = F.lit(cuts)
    step = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(cuts).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda s, _: F.struct(
            F.when((s["lo"] < s["hi"]) & (array[_middle(s)] < doc_id), _middle(s) + 1).otherwise(s["lo"]).alias("lo"),
            F.when((s["lo"] < s["hi"]) & (array[_middle(s)] >= doc_id), _middle(s)).otherwise(s["hi"]).alias("hi"),
        ),
    )
    return F.when(doc_id.isNull(), 0).otherwise(step["lo"] + 1)


def _middle(s: Column) -> Column:
    return F.least(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), F.greatest(s["hi"] - 1, F.lit(0)))


def edited(docs: DataFrame, parts: int) -> DataFrame:
    """Each document beside its edited text, in buckets of neighbouring doc_ids.

    Columns: bucket, place (in the bucket, descending doc_id), ghost, down (doc_id with all bits inverted), text, edited.
    The edit replaces the last half of a text by the first code points of the next document
    in descending doc_id (after the last: the first; null ids come last, ties by the text's
    hash). A bucket's last document finds its next one in a ghost row: the first document
    of the bucket below (for the lowest: of the highest), which is dealt to both. So texts
    are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bucket = _bucket(F.col("doc_id"), cuts) if cuts else F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    rows = rows.select(bucket.alias("bucket"), F.bitwise_not(F.col("doc_id")).alias("down"), F.xxhash64("text").alias("tie"), "text")
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.min(F.struct("down", "tie")).alias("top")).collect()}  # one row a bucket
    used = sorted(tops)
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    deal = F.array(own)
    if used:
        above = dict(zip(used, [*used[1:], used[0]], strict=True))
        to = F.create_map(*[F.lit(x) for b in used for x in (b, above[b])])[F.col("bucket")]
        down = F.create_map(*[x for b in used for x in (F.lit(b), F.lit(tops[b]["down"]).cast("long"))])[F.col("bucket")]
        tie = F.create_map(*[F.lit(x) for b in used for x in (b, tops[b]["tie"])])[F.col("bucket")]
        first = F.col("down").eqNullSafe(down) & (F.col("tie") == tie)
        deal = F.when(first, F.array(own, F.struct(to.alias("b"), F.lit(True).alias("ghost")))).otherwise(deal)
    # doc_id is kept in ``down`` alone, so that all uses of these rows read the same shuffle
    dealt = rows.select("down", "tie", "text", F.explode(deal).alias("x")).select(F.col("x.b").alias("bucket"), F.col("x.ghost").alias("ghost"), "down", "tie", "text")
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("down").asc_nulls_last(), "tie", "text")
    dealt = dealt.select("bucket", F.row_number().over(line).alias("place"), "ghost", "down", "text", F.lead("text").over(line).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    return dealt.select("bucket", "place", "ghost", "down", "text", F.when(~F.col("ghost"), text).alias("edited"))


def compare_edits(docs: DataFrame, parts: int) -> DataFrame:
    """For each document the fingerprints of its text and edited text, and their likenesses.

    All that follows the one shuffle by bucket groups, joins and looks ahead by bucket.
    """
    both = edited(docs, parts)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    texts = both.select("bucket", "place", F.explode(kinds).alias("x")).select("bucket", "place", "x.kind", "x.t").where("t is not null")
    prints = vectors(texts, ["bucket", "place", "kind"], "t")
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("lanes")))
    pairs = prints.groupBy("bucket", "place").agg(side(0).alias("a"), side(1).alias("b"))
    facts = both.select("bucket", "place", "ghost", "down", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"))
    line = Window.partitionBy("bucket").orderBy("place")
    full = facts.join(pairs, ["bucket", "place"]).withColumn("c", F.lead("a").over(line)).where("not ghost")
    return full.select(
        F.bitwise_not("down").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), text_form("a").alias("fingerprint"), text_form("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
