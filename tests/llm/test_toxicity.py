import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from meterlake.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    bad = ["vermin", "wretched", "numbskull"]
    rows, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "text"))
        labels.append((i, 1, toxic))
    labels += [(None, 1, 1), (5000, None, None), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels if a is not None)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and truth[r.doc_id] is not None]
    right = [(r.toxicity >= toxicity.THRESHOLD) == (truth[r.doc_id] == 1) for r in held]
    assert len(out) == 1200 and len(held) > 200 and sum(right) / len(right) > 0.97


def test_scores_do_not_depend_on_labels_of_held_out_rows(labelled):
    docs, labels, _ = labelled
    fold = "pmod(crc32(cast(doc_id as string)), 4)"
    flipped = labels.selectExpr("doc_id", "quality", f"if({fold} = 2, 1 - toxic, toxic) as toxic")
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.ratios == b.ratios).all()


def test_odd_rows_and_missing_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.score(empty, model).count() == 0


def test_folding():
    data, offsets = toxicity.folded(pa.array(["It's É-bad!!  Ok", "", "漢"]).cast(pa.large_string()))
    parts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert parts[1:] == [" ", " 漢"] and parts[0].startswith(" it s é bad ") and parts[0].rstrip().endswith("ok")


def test_ratios_equal_brute_force(labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)

    def read(text):
        data, _ = toxicity.folded(pa.array([text]).cast(pa.large_string()))
        return [data[i : i + toxicity.GRAM].tobytes() for i in range(len(data) - toxicity.GRAM + 1)]

    def at(gram):
        return int(toxicity.K.mix(np.array([int.from_bytes(gram, "little")], np.uint64))[0]) >> (64 - 23)

    rows = {r.doc_id: [at(g) for g in read(r.text)] for r in docs.collect()}
    n, everywhere = [Counter(), Counter()], Counter(c for got in rows.values() for c in got)
    for d, got in rows.items():
        if truth[d] is not None and zlib.crc32(str(d).encode()) % 4 in (0, 1):
            n[truth[d]].update(set(got))
    total = [sum(c.values()) for c in n]
    some = [c for c in {*n[0], *n[1]} if max(n[0][c], n[1][c]) > toxicity.DISCOUNT]
    assert any(n[1][c] > 30 for c in some)
    lam = [sum(min(v, toxicity.DISCOUNT) for v in n[k].values()) / total[k] for k in (0, 1)]
    for c in some:
        shared = (everywhere[c] + 0.5) / (sum(everywhere.values()) + 0.5 * toxicity.CELLS)
        p = [max(n[k][c] - toxicity.DISCOUNT, 0) / total[k] + lam[k] * shared for k in (0, 1)]
        assert abs(float(model.ratios[c]) - math.log(p[1] / p[0])) < 5e-3
    other = next(c for got in rows.values() for c in got if c not in set(some))
    assert abs(float(model.ratios[other]) - math.log(lam[1] / lam[0])) < 5e-3
