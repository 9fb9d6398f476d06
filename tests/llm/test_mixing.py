import math

import pytest
from meterlake.llm import mixing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "w " * (i % 9 + 1), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, copies string, n long")


def shares(out, weight):
    sums = {r.source: r.t for r in out.groupBy("source").agg(F.sum(weight).alias("t")).collect()}
    return {k: v / sum(sums.values()) for k, v in sums.items()}


def test_targets_are_met(sources):
    out = mixing.mix(sources, entropy=0.99, max_epochs=3.0).cache()
    assert out.count() == 3000 and out.agg(F.min("_copies")).first()[0] >= 1
    before, after = shares(out, F.col("n_tokens")), shares(out, F.col("n_tokens") * F.col("_copies"))
    entropy = lambda p: -sum(x * math.log(x) for x in p.values()) / math.log(len(p))
    assert entropy(before) < 0.99 and abs(entropy(after) - 0.99) < 2e-3
    epochs = {k: after[k] / before[k] for k in before}
    low = min(epochs.values())
    assert epochs["big"] == low
    for k, e in epochs.items():  # within a document of the weight
        assert abs(e / low - (before["big"] / before[k]) ** (math.log(e / low) / math.log(before["big"] / before[k]) if k != "big" and e > low else 0)) < 1e-6
    assert mixing.realise(out).count() == out.agg(F.sum("_copies")).first()[0]
    assert mixing.realise(out).columns == ["doc_id", "text", "source", "copies", "n"]


def test_epoch_limit(sources):
    out = mixing.mix(sources, entropy=1.0, max_epochs=1.25)
    before, after = shares(out, F.col("n_tokens")), shares(out, F.col("n_tokens") * F.col("_copies"))
    epochs = [after[k] / before[k] for k in before]
    assert max(epochs) / min(epochs) < 1.26


def test_budget(sources):
    out = mixing.mix(sources, budget=5000)
    total = out.agg(F.sum(F.col("n_tokens") * F.col("_copies"))).first()[0]
    assert 5000 - 9 * 8 <= total <= 5000 + 8


def test_odd_rows_and_plan(docs, empty):
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.where("_copies is null or _copies < 1").count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix(empty).count() == 0
