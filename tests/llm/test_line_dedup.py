from collections import Counter, defaultdict

import pytest
from meterlake.llm import line_dedup
from pyspark.sql import functions as F


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_lines_equal_brute_force(spark, broadcast_lines):
    rows = []
    for i in range(60):
        lines = [f"own {i}", "menu" if i % 2 else " menu ", "", "footer" if i % 7 == 0 else f"x{i}", "menu"]
        rows.append((i, "big" if i < 40 else None if i < 45 else f"site{i % 3}", "\n".join(lines), "clash"))
    rows += [(None, "big", None, "c"), (60, "big", "", "c"), (60, "big", "", "c")]
    frame = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines string").repartition(4)
    got = Counter((r.page_id, r.host, r.text, r._n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(frame, "host", "text", 0.2, 5, broadcast_lines).collect())
    pages, seen = Counter(r[1] for r in rows), defaultdict(int)
    for _, host, text, _ in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else ():
            seen[host, line] += 1
    want = Counter()
    for i, host, text, _ in rows:
        if text is None:
            want[i, host, None, 0, 0] += 1
            continue
        lines = text.split("\n")
        kept = [x for x in lines if host is None or pages[host] < 5 or not x.strip(" ") or seen[host, x.strip(" ")] <= 0.2 * pages[host]]
        want[i, host, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert got == want and sum(k[4] for k in want) > 0


def test_no_python_in_the_plan(spark, docs):
    plan = line_dedup.drop_boilerplate(docs, "source", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(docs, empty):
    out = line_dedup.drop_boilerplate(docs, "source", "text")
    assert out.count() == docs.count()
    assert line_dedup.drop_boilerplate(empty, "source", "text").count() == 0


def test_page_lines(spark):
    pages = spark.createDataFrame([(1, "https://a.b.c/x?y", "<p>one</p><p>two"), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.text) for r in line_dedup.page_lines(pages).collect()}
    assert got[1] == ("a.b.c", "\none\n\ntwo") and got[2] == (None, None) and got[3] == (None, "")
    assert line_dedup.drop_boilerplate(line_dedup.page_lines(pages), "host", "text").agg(F.count("*")).first()[0] == 3
