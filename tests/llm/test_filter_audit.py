from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from meterlake.llm import filter_audit as fa

from tests_llm_tools import words

LABELS = "doc_id long, quality int, toxic int, part string"


def masks(rows):
    """part, mask, good and toxic of each document, by the rules."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, part, good, toxic in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        out.append((part or "", frozenset(k for k, v in fails.items() if v), good, toxic))
    return out


def brute(docs, labels):
    known = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            known[i][0] |= quality == 1
            known[i][1] |= toxic == 1
    each = masks([(i, t, s, *(known[i] if i is not None else (0, 0))) for i, t, s in docs])
    out, shapley = {}, Counter()
    for part in {p for p, *_ in each}:
        own = [x for x in each if x[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            gone = []
            for step, f in enumerate(order, 1):
                bad = [x for x in left if f in x[1]]
                row = [len(left) - len(bad), len(bad), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in own), sum(x[2] for x in bad), sum(x[3] for x in bad)]
                left = [x for x in left if f not in x[1]]
                gone += bad
                shapley[part, f] += len(bad)
                out[part, "".join(order), step] = row
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(docs, labels):
    frame = fa.audit_documents(docs, labels)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in fa.COUNTS) for r in frame.collect()}


def test_audit_equals_brute_force(spark, docs, texts):
    long = [" ".join(f"w{j}{'#' if n == 1 else ''}" for j in range(80)) + (" ABCDEFGH" * 4 if n == 2 else "") for n in range(3)]
    extra = spark.createDataFrame([(5000 + n, long[n % 3], "en", ["s0", None, ""][n % 3], 0, "x", 0, "y", 0, 0) for n in range(30)], docs.schema)
    every = docs.unionByName(extra)
    rows = [(r.doc_id, r.text, r.source) for r in every.collect()]
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 5030, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (99999, 1, 1)]
    labels = spark.createDataFrame([(*m, "clash") for m in marks], LABELS)
    want = brute(rows, marks)
    found = got(every, labels)
    assert found == want and len(want) == 600 * len({r[2] or "" for r in rows})
    assert any(v[4] for v in want.values()) and any(v[5] for v in want.values()) and any(v[6] for v in want.values())


def test_hadamard_inverts():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 1 << 40, 32)
    assert (fa.invert(fa.hadamard(5) @ cells, 5) == cells).all()


def test_orders_and_letters(spark):
    rows = spark.createDataFrame([("p", 3, 1, 0)], "part string, mask int, good int, toxic int")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in fa.audit(rows, "XYZ").collect()}
    assert len(out) == 18 and out["XYZ", 1] == (0, 1, 0, 1, 3) and out["XYZ", 2] == (0, 0, 1, 0, 3) and out["ZYX", 1] == (1, 0, 0, 0, 0)


def test_empty_and_unlabelled(spark, docs, empty):
    labels = spark.createDataFrame([], LABELS)
    assert fa.audit_documents(empty, labels).count() == 0
    assert all(v[4] == v[5] == 0 for v in got(docs, labels).values())
