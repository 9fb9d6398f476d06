import random
import re
from math import floor, log

from meterlake.llm import license_scan as lic
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALL = lic.BASE + lic.NOTICES


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, templates=ALL, least=lic.MIN_SHARE):
    split = [words(t) for _, t in rows]
    n = len(rows)
    weight = {w: floor(1000 * log((2 * n + 2) / (2 * sum(w in set(x) for x in split) + 1))) for t in templates for w in t.text.split()}
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        base, labels, best = [], set(), 0.0
        for t in templates:
            key, own = t.key.split(), t.text.split()
            off = next(j for j in range(len(own)) if own[j : j + len(key)] == key)
            for s in range(len(w) - len(key) + 1):
                if w[s : s + len(key)] == key:
                    hit = sum(weight[x] for j, x in enumerate(own) if 0 <= s - off + j < len(w) and w[s - off + j] == x)
                    whole = sum(weight[x] for x in own)
                    share = hit / whole if whole else 1.0
                    if t.base or share >= least:
                        labels.add(t.label)
                        best = max(best, share)
                    if t.base:
                        base.append((s, t.label))
        out.append((i, len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 12)))
    return sorted(out, key=str)


def test_scan_equals_brute_force(spark, docs):
    rng = random.Random(4)
    pieces = [t.text for t in ALL] + ["Under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "CC-BY-SA", "all rights reserved", "the mit", "cc by", "license version", "nc nc by nc", "\n", "gnu general public license version 3", "cc by sa 4 0"]
    made = [" ".join(rng.choice([*pieces, "foo", "Bär", "the", "x1"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    made += ["under the mit license under the mit license", "cc by nc " * 3000, "MIT-LICENSE under THE_MIT license", "under the mit", "ünder the mit license", "a gnu general public license version 3", "x y cc by sa 4 0", "the terms of the mozilla public license v 2 0"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string"))
    frame = frame.withColumns({"w": F.lit("clash"), "found": F.lit(1), "labels": F.lit("clash")}).cache()
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = brute(rows)
    got = sorted(((*r[:7], round(r.score, 12)) for r in lic.scan(frame).collect()), key=str)
    assert got == want and sum(r[2] for r in want) > 3000 and any(r[6] != r[5] for r in want) and any(0 < r[7] < 1 for r in want)


def test_labels_of_usual_notices(spark):
    said = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "a licence of one's own", None]
    frame = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels, r.n_base) for r in lic.scan(frame).collect()}
    assert got == {0: ("mit", "mit", 1), 1: ("apache-2", "apache-2", 1), 2: ("cc-by-nc", "cc-by-nc", 1), 3: ("", "gpl-3", 0), 4: ("", "proprietary", 0), 5: ("", "", 0), 6: ("", "", 0)}


def test_no_python_and_no_rows_moved(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    plan = lic.scan(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_callers_columns_stay(spark, empty):
    frame = spark.createDataFrame([(1, "cc by nc", "mine")], "doc_id long, text string, w string")
    r = lic.find_licenses(frame).first()
    assert r.w == "mine" and r._w == ["cc", "by", "nc"] and [f.label for f in r.found if f.base] == ["cc-by-nc"]
    assert lic.scan(empty).count() == 0
