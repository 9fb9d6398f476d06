import numpy as np
from meterlake.llm import embedding_dedup
from tests_llm_tools import components_of


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 20))
    rows = []
    for i, v in enumerate(base):
        for j in range(i % 6):
            noise = rng.standard_normal(20) * (0.02 + 0.03 * j)
            rows.append((v + noise).astype(np.float32).tolist())
        rows.append((v * 3).astype(np.float32).tolist())
        if i % 3 == 0:
            rows += [v.astype(np.float32).tolist()] * 3
    rows = [(i, v, i % 7 % 2) for i, v in enumerate(rows)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 20, 1), (n + 2, [float("nan")] + [1.0] * 19, 1), (n + 3, [None] + [1.0] * 19, 0), (n + 4, rows[0][1], None), (None, rows[0][1], 0), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [float("inf")] * 20, 1), (n + 9, [1e-30] * 20, 0), (n + 10, [1e30] * 20, 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98 - 1e-12) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b] + [(n + 6, n + 7), (n + 9, n + 10)]
    want = components_of(range(n + 11), [(int(a), int(b)) for a, b in links])
    assert len(got) == n + 12 and len(links) > 100
    for i in range(n):
        assert got[i].n_links == near[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    for i in range(n, n + 6):
        assert got[i].n_links == 0 and got[i].kept
    assert got[n + 6].n_links == got[n + 7].n_links == 1 and got[n + 10].component_id == n + 9
    assert got[None].n_links == 0


def test_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
