from collections import Counter

import pytest
from meterlake.llm import substring_dedup
from pyspark.sql import functions as F
from tests_llm_tools import words


def brute(rows):
    first = {}
    for r in rows:
        if r.doc_id is not None:
            w = words(r.text)
            for j in range(len(w) - 49):
                k = tuple(w[j : j + 50])
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        w = words(r.text)
        keep = [True] * len(w)
        if r.doc_id is not None:
            for j in range(len(w) - 49):
                if first[tuple(w[j : j + 50])] < r.doc_id:
                    keep[j : j + 50] = [False] * 50
        out.append((r.doc_id, " ".join(x for x, k in zip(w, keep, strict=True) if k), len(w), keep.count(False)))
    return out


@pytest.mark.parametrize(("batches", "fan"), [(1, 4), (4, 1)])
def test_removals_equal_brute_force(docs, batches, fan):
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, batches, fan).collect())
    want = Counter(brute(docs.collect()))
    assert got == want and sum(n for *_, n in want) > 0


def test_batches_one_after_the_other(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tk", F.hash("text")).withColumn("batch", F.lit(0))
    index, spans = substring_dedup.WindowIndex(spark, fan=2), []
    for i in range(4):
        spans.append(index.add(substring_dedup.postings(rows.where(f"doc_id div 15 = {i}")).drop("batch"), rows.where(f"doc_id div 15 <= {i}").drop("batch")))
        assert len(index.runs) <= 3
    index.close()
    found = {(r.doc_id, r.at + j) for s in spans for r in s.collect() for j in range(r.n)}
    first = {}
    want = set()
    for i, t in enumerate(texts[:60]):
        w = words(t)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                want.add((i, j))
    assert found == want


def long_text(mark, passage):
    return " ".join([*(f"{mark}l{i}" for i in range(30)), *passage, *(f"{mark}r{i}" for i in range(30))])


@pytest.mark.parametrize("batches", [1, 3])
def test_long_rows_that_repeat_a_doc_id(spark, batches):
    """Two different rows of one doc_id hold a passage in shared surroundings, at an anchor that is mixed."""
    passage = [f"p{i}" for i in range(56)]
    near = long_text("b", passage)
    rows = [(0, long_text("a", passage)), (5, near), (5, near + " and more"), (7, near), (9, None), (3, "few words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(frame, batches).collect())
    assert got == Counter(brute(frame.collect()))
    assert sorted(n for d, _, _, n in got if d == 5) == [56, 56]


def test_exact_copies(spark):
    """Later copies lose all their windows' words; shorter texts lose none; a repeated doc_id is no source for itself."""
    text, brief = long_text("a", [f"p{i}" for i in range(56)]), " ".join(["w" * 30] * 49)
    rows = [(d, t) for d in (4, 2, 2, 9, 9, None) for t in (text, brief, "", None)] + [(8, long_text("b", [f"p{i}" for i in range(56)]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(frame).collect())
    assert got == Counter(brute(frame.collect()))
    copies = substring_dedup.later_copies(frame.where("doc_id is not null").withColumn("tk", F.hash("text")))
    assert sorted(r.doc_id for r in copies.collect()) == [4, 4, 9, 9, 9, 9]  # long enough by characters, the brief one too


def test_hot_keys_lie_apart(docs, monkeypatch):
    """With a limit of one row nearly every repeated key is hot, and results stay."""
    monkeypatch.setattr(substring_dedup, "hot_limit", lambda rows: 1)
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == Counter(brute(docs.collect()))


def test_runs_are_merge_joined_without_moving(spark, docs):
    known = docs.where("doc_id is not null").select("doc_id", "text", F.hash("text").alias("tk"), F.lit(0).alias("batch"))
    index = substring_dedup.WindowIndex(spark)
    for half in ("doc_id < 20", "doc_id >= 20"):
        index.add(substring_dedup.postings(known.where(half)).drop("batch"), known.drop("batch"))
    one, two = index.runs
    joined = one.cold.join(two.cold.select("fp").hint("merge"), "fp", "left_semi").groupBy("fp", "seg").agg(F.min("d"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
