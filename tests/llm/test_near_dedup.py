import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import _graph, _kernels, near_dedup
from tests_llm_tools import components_of, words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check(frame):
    got = frame.select("doc_id", "text").collect()
    sets = {}
    for r in got:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append(shingles(r.text))
    links = []
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= 75 * (len(x) + len(y) - both):
                        links.append((a, b))
    want = components_of(ids, links)
    out = near_dedup.near_duplicates(frame).collect()
    assert len(out) == len(got)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    return want


def test_components_equal_brute_force(docs):
    want = check(docs)
    assert len(set(want.values())) < len(want)


def test_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        for j in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{i}-{j}"
        texts.append(" ".join(w))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.fixture
def one_bucket(monkeypatch):
    """All documents meet in one bucket, and in no other."""
    whole = near_dedup._sketch

    def sketch(batches):
        for b in whole(batches):
            bands = pa.array([[7, *(-1000 * d - k for k in range(1, near_dedup.BANDS))] for d in b.column(0).to_pylist()], b.schema.field("bands").type)
            yield b.set_column(b.schema.get_field_index("bands"), "bands", bands)

    monkeypatch.setattr(near_dedup, "_sketch", sketch)


def drifted(start, marks, at):
    w = list(start)
    for k in at:
        w[6 * k + 5] = f"{marks}-{k}"
    return w


def test_apart_document_meets_every_member_of_a_large_bucket(spark, one_bucket):
    base = [f"w{i}" for i in range(200)]
    texts = [base]
    near = [drifted(base, f"m{i}", [i % 20]) for i in range(60)]
    # 0.77 with one member, 0.73 with the pivot
    far = [drifted(w, f"d{i}", range(22, 27)) for i, w in enumerate(near[:30])]
    texts += near + far
    want = check(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert set(want.values()) == {0}


def test_few_apart_documents_meet_others_once_over_all_buckets(spark, monkeypatch):
    """Two buckets hold nearly the same members; a short text shares them, but its size allows no link."""
    whole, stage, staged = near_dedup._sketch, near_dedup.stage_table, {}

    def sketch(batches):
        for b in whole(batches):
            bands = pa.array([[7, 8 if d != 2 else -8, *(-1000 * d - k for k in range(2, near_dedup.BANDS))] for d in b.column(0).to_pylist()], b.schema.field("bands").type)
            yield b.set_column(b.schema.get_field_index("bands"), "bands", bands)

    def kept(rows, name):
        staged[name] = stage(rows, name)
        return staged[name]

    monkeypatch.setattr(near_dedup, "_sketch", sketch)
    monkeypatch.setattr(near_dedup, "stage_table", kept)
    base = [f"w{i}" for i in range(200)]
    near = [drifted(base, f"m{i}", [i]) for i in range(2)]
    far = drifted(near[0], "d", range(22, 27))
    texts = [base, *near, far, base[:60]]
    want = check(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert want == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert sorted((r.pivot, r.d) for r in staged["pairs"].collect()) == [(1, 3), (2, 3)]


def test_apart_documents_meet_each_other_in_a_large_bucket(spark, one_bucket):
    texts = [[f"w{i}" for i in range(200)]]
    for i in range(30):
        one = [f"{i}-{j}" for j in range(200)]
        texts += [one, drifted(one, "d", range(5))]
    want = check(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert len(set(want.values())) == 31


def exact_links(texts):
    """All pairs at 0.75 or more, from one matrix of the texts' shingles."""
    sets = [shingles(t) for t in texts]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    n = held.sum(axis=1)
    both = held @ held.T
    a, b = np.nonzero(100 * both >= 75 * (n[:, None] + n[None, :] - both))
    return [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]


def test_template_loses_no_link(spark):
    """Many variants of one template; each derived text is near to one variant only."""
    rng = np.random.default_rng(8)
    slots = [[f"s{i}-{j}" for j in range(6)] for i in range(100)]

    def variant(gone):
        return [w for i, s in enumerate(slots) if i not in gone for w in s]

    texts = [variant(set(rng.choice(100, 6, replace=False).tolist())) for _ in range(700)]
    for d in range(60):
        w = list(texts[int(rng.integers(700))])
        for k in range(15):
            w[30 * k + 5] = f"d{d}-{k}"
        texts.append(w)
    texts = [" ".join(w) for w in texts]
    links = exact_links(texts)
    want = components_of(range(len(texts)), links)
    assert any(b >= 700 for _, b in links)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    recall = np.mean([got[a] == got[b] for a, b in links])
    print(f"recall of {len(links)} links: {recall:.4f}")
    assert recall >= 0.99 and got == want


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(1, 6000, 12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert near_dedup.common(sets[:5], sets[5:]).tolist() == want
    assert near_dedup.common(sets[:2], sets[5:]).tolist() == want[:2]
    assert near_dedup.common([sets[0]] * 5, [sets[1] + np.uint64(10**6)]).tolist() == [[0]] * 5


def test_repeated_doc_id_is_linked_by_each_text(spark, monkeypatch):
    """One of a doc_id's texts is a copy; its other text still links. Sets are also dealt by salt."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = two.replace("b59", "z")
    rows = [(1, one), (5, one), (5, two), (9, near), (10, three), (11, three)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = check(frame)
    assert want[9] == 1 and want[11] == 10
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    check(frame)


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    e = _kernels.mix(rng.integers(0, 1 << 62, 600).astype(np.uint64))
    a, b = e[:500], e[100:]
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [500, 500]), 2)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.15
    one = near_dedup.superminhash(e[:1], np.zeros(1, int), 2)
    assert len(np.unique(one[0])) == near_dedup.LANES and (one[1] == np.iinfo(np.uint64).max).all()


def test_union_find_chunk():
    node, root = _graph.union_find(np.array([5, 4, 9, 3]), np.array([4, 3, 8, 2]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_components_of_a_chain(spark, chunk):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 2000), (None, 3), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in _graph.components(links.repartition(7), chunk).collect()}
    assert got[300] == 1 and got[2000] == 1000 and len(got) == 302


def test_word_hashes_follow_words():
    t = pa.array(["a bc  a\tbc", "", "bc"]).cast(pa.large_string())
    w = _kernels.split_words(t)
    h = _kernels.word_hashes(w)
    assert w.bounds.tolist() == [0, 4, 4, 5] and h[0] == h[2] and h[1] == h[3] == h[4] and h[0] != h[1]
