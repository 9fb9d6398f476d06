import random
import zlib

import pytest
from meterlake.llm import resampling


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    good, junk = [f"word{i}" for i in range(200)], [f"zz{i}%%" for i in range(200)]
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else good) for _ in range(rng.randint(10, 60)))) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 800, 2)], "doc_id long, quality int, toxic int")


def test_sample_follows_the_target(labelled):
    docs, labels = labelled
    kept = {r.doc_id for r in resampling.resample(docs, labels, 0.75).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(kept) == 600
    assert sum(i in kept for i in held if i % 4) / sum(1 for i in held if i % 4) > 0.97
    assert sum(i in kept for i in held if i % 4 == 0) / sum(1 for i in held if i % 4 == 0) < 0.06


def test_top_is_exact(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.gauss(0, 1), 0.5, 1e9, -1e-9]) for _ in range(4000)]
    frame = spark.createDataFrame(list(enumerate(keys)), "doc_id long, key double")
    for k in (0, 1, 7, 1500, 3999, 4000, 9000):
        got = {r.doc_id for r in resampling.top(frame, k).collect()}
        want = {i for _, i in sorted(((x, i) for i, x in enumerate(keys)), reverse=True)[:k]}
        assert got == want


def test_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(docs, none).count() == docs.count()
    assert 0 < resampling.resample(docs, none, 0.5).count() < docs.count()
    assert resampling.resample(empty, none).count() == 0
