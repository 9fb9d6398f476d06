import hashlib

from meterlake.llm import fingerprints
from pyspark.sql import functions as F


def test_edits_and_equality(docs):
    rows = docs.select("doc_id", "text").collect()
    out = fingerprints.compare_edits(docs, 5).collect()
    assert len(out) == len(rows)
    known = {}
    for r in rows:
        known.setdefault(r.doc_id, set()).add(r.text or "")
    order = sorted((k for k in known if k is not None), reverse=True)
    for i, k in enumerate(order[:-1]):
        if k == 3 or len(known[order[i + 1]]) > 1:  # the repeated row is its own next document
            continue
        text, after = next(iter(known[k])), next(iter(known[order[i + 1]]))
        half = len(text) // 2
        want = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        got = [r for r in out if r.doc_id == k]
        assert all(r.edited_sha256 == want and r.n_chars == len(text) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    prints = {}
    for r in out:
        if r.doc_id is not None and len(known[r.doc_id]) == 1:
            prints.setdefault(r.fingerprint, set()).add(next(iter(known[r.doc_id])))
    assert all(len(v) == 1 for v in prints.values())


def test_order_insertion_and_deletion(spark):
    rows = [(0, "a b c d\ne f g\nh i"), (1, "h i\na b c d\ne f g"), (2, "a b c d\nh i"), (3, "e f g")]
    v = fingerprints.vectors(spark.createDataFrame(rows, "k long, t string"), ["k"], "t").cache()
    one = {r.k: r.lanes for r in v.collect()}
    assert one[0] == one[1] and one[0] != one[2]
    pair = v.where("k = 2").select(F.col("lanes").alias("a")).join(v.where("k = 3").select(F.col("lanes").alias("b")))
    assert pair.select(fingerprints.combine("a", "b").alias("s")).first().s == one[0]
    pair = v.where("k = 0").select(F.col("lanes").alias("a")).join(v.where("k = 3").select(F.col("lanes").alias("b")))
    assert pair.select(fingerprints.combine("a", "b", -1).alias("s")).first().s == one[2]


def test_one_document_is_its_own_next(spark):
    r = fingerprints.compare_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string"), 4).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_empty_and_plan(docs, empty):
    assert fingerprints.compare_edits(empty, 4).count() == 0
    assert "Python" not in fingerprints.compare_edits(docs, 4)._jdf.queryExecution().toString()
