"""The registered queries read their tables from a folder and give the contract's columns."""

from itertools import permutations

import pytest
from meterlake.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    texts = ["Released under the MIT License.", "cc by nc", "under the mit license cc by nc under the mit license", None, "", "cc by nc"]
    spark.createDataFrame([(i, t, "en", None if i == 3 else "s", len(t or ""), "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(7, "MIT license"), (8, "nothing here"), (9, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_search(spark, folder):
    out = queries.op11_lexical_search(spark, folder)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    # both terms stand in two of four documents: w = floor(1000 ln(10 / 5)) = 693
    rows = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    lengths = {0: 5, 1: 3, 2: 11, 5: 3}
    whole = sum(lengths.values())
    score = lambda i, tf: 2 * 693 * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * lengths[i] * 4 // whole)))
    want = sorted([(-score(0, 1), 0), (-score(2, 2), 2)])
    assert rows == {(7, n): (i, -s) for n, (s, i) in enumerate(want, 1)}


def test_audit(spark, folder):
    out = queries.op12_filter_audit(spark, folder)
    assert dict(out.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    rows = {(r.part, r.filter_order, r.step): r for r in out.collect()}
    assert set(rows) == {(p, "".join(o), s) for p in ("s", "") for o in permutations("ABCDE") for s in range(1, 6)}
    # all texts are short; three of the words of the third are new in eleven; the last repeats the second, the empty one the null one
    r = rows["s", "EABCD", 1]
    assert (r.kept, r.removed, r.good_lost, r.toxic_lost, rows["s", "ABCDE", 5].redundant) == (3, 2, 1, 1, 2)
    assert rows["", "ABCDE", 1].removed == 1 and rows["", "ABCDE", 1].shapley == 120


def test_scan(spark, folder):
    out = queries.op13_license_scan(spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got[0] == (5, 1, 1, 1, "mit", "mit", 1.0) and got[1] == got[5] == (3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[2] == (11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit", 1.0) and got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
