"""Temperature mixing of sources, in DataFrame operations only.

With t_i the tokens (words) of source i and p_i its share, the target weight is
p_i ** alpha, normalised. Alpha is bisected on [0, 1]: the largest value whose weights
reach ``entropy`` (as a share of the log of the number of sources), but not below the
value at which the most repeated source is used ``max_epochs`` times as often as the
least repeated. A source is used e_i = (t_max / t_i) ** (1 - alpha) epochs, times
budget / sum(e_i * t_i) where a budget in tokens is given; without one the largest
source is used once and no document is lost.

Epochs are realised over hashed blocks: whole epochs give every document floor(e_i)
copies; the rest of the source's budget is filled in the order of the documents' hashes,
block after block. Only block totals are ordered by source (4,096 blocks at most for a
source), and only the block in which the budget ends is ordered by document; what
results is one cut hash for each source, which decides every document in place.

Texts are read twice: once for the staged (source, tokens, order) of each document, from
which the plan is made, and once for the result.

Defined cases: null text has no tokens; a null source is a source of its own; a source
without tokens is used once; rows repeating a doc_id share their fate; an empty table
stays empty; a caller's column named like a result stays, and the result's name gets an
underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm._spark import free_name, stage_table

ENTROPY, MAX_EPOCHS, DIGITS, STEPS = 0.95, 1.5, 3, 40
BROADCAST_SOURCES = 100_000  # about 100 bytes each
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(totals: DataFrame, entropy: float, max_epochs: float) -> float:
    """Bisects alpha over the sources' totals ``t``, gathered as one array in one row."""
    row = totals.where("t > 0").agg(F.sort_array(F.collect_list(F.col("t").cast("double"))).alias("t"))
    bisect = f"""
        aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> named_struct(
            'lo', IF(good((s.lo + s.hi) / 2), (s.lo + s.hi) / 2, s.lo), 'hi', IF(good((s.lo + s.hi) / 2), s.hi, (s.lo + s.hi) / 2)))
    """
    # entropy of the weights at exponent a: ln(sum w) - sum(w ln w) / sum(w)
    total = "aggregate(t, 0D, (z, x) -> z + pow(x / t_max, {a}))"
    logs = "aggregate(t, 0D, (z, x) -> z + pow(x / t_max, {a}) * {a} * ln(x / t_max))"

    def search(test: str, f: str) -> str:
        text = bisect
        while "good(" in text:
            at = text.index("good(")
            depth, end = 1, at + 5
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            text = text[:at] + "(" + test.replace("{a}", "(" + text[at + 5 : end - 1] + ")") + ")" + text[end:]
        return text + f

    reached = f"(ln({total}) - {logs} / {total}) >= {entropy}D * ln(size(t))"
    repeated = f"pow(t_max / t_min, 1D - {{a}}) > {max_epochs}D"
    named = row.where("size(t) > 1").selectExpr("t", "t[size(t) - 1] AS t_max", "t[0] AS t_min")
    found = named.selectExpr(
        f"IF({reached.replace('{a}', '1D')}, 1D, {search(reached, '.lo')}) AS by_entropy",
        f"IF(NOT ({repeated.replace('{a}', '0D')}), 0D, {search(repeated, '.hi')}) AS by_epochs",
    ).selectExpr("round(greatest(by_entropy, by_epochs), 6) AS alpha")
    first = found.first()
    return first["alpha"] if first else 1.0


def order(doc_id: str) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def mix(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """All columns of ``docs(doc_id, text, source, ...)``, then ``n_tokens`` and ``copies`` of each document."""
    names = docs.columns
    rows = stage_table(docs.select(F.col("source").alias("s"), tokens(F.col("text")).alias("n"), order("doc_id").alias("h")), "measured")
    blocks = rows.groupBy("s", F.substring("h", 1, DIGITS).alias("block")).agg(F.sum("n").alias("n"))
    totals = blocks.groupBy("s").agg(F.sum("n").alias("t"))
    alpha = exponent(totals, entropy, max_epochs)
    ends = totals.agg(F.max("t").alias("t")).first()["t"] or 0
    epochs = F.when(F.col("t") > 0, F.round(F.pow(F.lit(float(ends)) / F.col("t"), F.lit(1.0 - alpha)), 6)).otherwise(F.lit(1.0))
    plan = totals.withColumn("e", epochs)
    if budget is not None:
        whole = plan.agg(F.sum(F.col("e") * F.col("t")).alias("x")).first()["x"] or 1.0
        plan = plan.withColumn("e", F.round(F.col("e") * F.lit(budget / whole), 6))
    plan = plan.select("s", F.floor("e").alias("full"), F.floor((F.col("e") - F.floor("e")) * F.col("t")).alias("rest"))
    before = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocks.withColumn("upto", F.sum("n").over(before))
    edges = summed.join(plan, summed["s"].eqNullSafe(plan["s"])).drop(plan["s"])
    edges = edges.where("upto > rest").groupBy("s", "full", "rest").agg(F.min_by(F.struct("block", F.expr("upto - n").alias("done")), "block").alias("edge"))
    edges = edges.select(F.col("s").alias("es"), "full", "rest", F.col("edge.block").alias("eb"), F.col("edge.done").alias("done"))
    # documents of the one block of each source in which its budget ends
    inside = rows.join(edges, F.col("s").eqNullSafe(F.col("es")) & (F.substring("h", 1, DIGITS) == F.col("eb")))
    inside = inside.groupBy("s", "h", "done", "rest").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside.withColumn("upto", F.sum("n").over(running) + F.col("done")).where("upto <= rest").groupBy("s").agg(F.max("h").alias("cut"))
    edges = edges.join(cuts, F.col("es").eqNullSafe(F.col("s")), "left").select("es", F.coalesce("cut", "eb").alias("cut"))
    plan = plan.join(edges, F.col("s").eqNullSafe(F.col("es")), "left").select(F.col("s").alias("__s"), F.col("full").alias("__full"), F.coalesce("cut", F.lit("g")).alias("__cut"), F.col("rest").alias("__rest"))
    if totals.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left")
    extra = F.when((F.col("__rest") > 0) & (order("doc_id") <= F.col("__cut")), 1).otherwise(0)
    found = [tokens(F.col("text")).alias(free_name(docs, "n_tokens")), (F.col("__full") + extra).cast("long").alias(free_name(docs, "copies"))]
    return joined.select(*[docs[c] for c in names], *found)


def realise(mixed: DataFrame) -> DataFrame:
    """Each document as often as the last column of ``mixed`` says, with the columns before mixing."""
    *names, _, copies = mixed.columns
    return mixed.where(F.col(copies) > 0).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("__copy")).drop("__copy")


def oracle(table: str = "documents", ctes: str = "") -> str:
    good = "(ln(list_sum(list_transform(t, lambda x: pow(x / tm, {a})))) - list_sum(list_transform(t, lambda x: pow(x / tm, {a}) * {a} * ln(x / tm))) / list_sum(list_transform(t, lambda x: pow(x / tm, {a})))) >= " + f"{ENTROPY} * ln(len(t))"
    more = f"pow(tm / t0, 1 - {{a}}) > {MAX_EPOCHS}"
    mid = "((lo + hi) / 2)"
    return f"""
WITH RECURSIVE {ctes} r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS n_tokens, md5('mix:' || coalesce(doc_id::varchar, '')) AS h FROM {table}
), totals AS (SELECT source, sum(n_tokens)::bigint AS t FROM r GROUP BY source),
a AS (SELECT list(t::double ORDER BY t) AS t, max(t)::double AS tm, min(t)::double AS t0 FROM totals WHERE t > 0),
b1(i, lo, hi) AS (SELECT 0, 0::double, 1::double UNION ALL SELECT i + 1, CASE WHEN {good.format(a=mid)} THEN {mid} ELSE lo END, CASE WHEN {good.format(a=mid)} THEN hi ELSE {mid} END FROM b1, a WHERE i < {STEPS}),
b2(i, lo, hi) AS (SELECT 0, 0::double, 1::double UNION ALL SELECT i + 1, CASE WHEN {more.format(a=mid)} THEN {mid} ELSE lo END, CASE WHEN {more.format(a=mid)} THEN hi ELSE {mid} END FROM b2, a WHERE i < {STEPS}),
alpha AS (SELECT CASE WHEN len(a.t) < 2 THEN 1 ELSE round(greatest(CASE WHEN {good.format(a='1::double')} THEN 1 ELSE b1.lo END, CASE WHEN NOT ({more.format(a='0::double')}) THEN 0 ELSE b2.hi END), 6) END AS alpha
  FROM a, b1, b2 WHERE b1.i = {STEPS} AND b2.i = {STEPS}),
e AS (SELECT source, t, CASE WHEN t > 0 THEN round(pow((SELECT max(t)::double FROM totals) / t, 1 - alpha), 6) ELSE 1 END AS e FROM totals, alpha),
pl AS (SELECT source, floor(e)::bigint AS whole, floor((e - floor(e)) * t)::bigint AS rest FROM e),
c AS (SELECT source, h, sum(sum(n_tokens)) OVER (PARTITION BY source ORDER BY h) AS upto FROM r GROUP BY source, h)
SELECT r.doc_id, r.source, r.n_tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::bigint AS copies
FROM r JOIN pl ON r.source IS NOT DISTINCT FROM pl.source JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.h = c.h
"""
