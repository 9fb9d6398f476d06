from collections import Counter, defaultdict

import pytest
from meterlake.llm import toxicity
from tests_llm_tools import components_of, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
BAD = ["you are a vile stupid idiot", "go away you worthless moron", "shut up disgusting fool"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Invented documents, odd ones, a boilerplate line in one source, and planted toxic ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.sparkContext.setLogLevel("ERROR")
    rows = [tuple(r) for r in docs.select(*NAMES).collect()]
    clean = [r for r in rows if r[1] and len(words(r[1])) >= 20]
    labels = [(r[0], 1, 0) for r in clean if r[0] is not None]
    for i in range(60):
        w = words(clean[i % len(clean)][1])[:60]
        rows.append((2000 + i, " ".join([*w[: 5 + i % 9], *BAD[i % 3].split(), *w[20:], f"t{i}"]), "en", f"s{i % 3}", 1))
        labels.append((2000 + i, 0, 1))
    for i in range(30):
        rows.append((3000 + i, f"subscribe to our letter\nown words {i} " + " ".join(f"{i}-{k}" for k in range(30)), "en", "site", 1))
    rows += [(3100, None, None, "site", None), (3101, "same id", "en", "s0", 7), (3101, "other text of that id", "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def values(frame):
    return Counter(tuple(r) for r in frame.select(*NAMES).collect())


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def after_lines(rows):
    """Lines on more than a tenth of a source's rows (ten at least) fall away."""
    by = defaultdict(list)
    for r in rows.elements():
        by[r[3]].append(r)
    out = Counter()
    for source, some in by.items():
        seen = Counter(x for r in some if r[1] is not None for x in {x.strip(" ") for x in r[1].split("\n")} - {""})
        often = {x for x, n in seen.items() if n > 1 and n > 0.1 * len(some)} if source is not None and len(some) >= 10 else set()
        for r in some:
            text = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in often)
            out[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    return out


def after_near(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    least = components_of([a for a, _ in sets], links)
    return Counter({r: n for r, n in rows.items() if r[0] is None or least[r[0]] == r[0]})


def test_each_stage_equals_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    at = spark.read.parquet(f"{folder}/documents.parquet")
    given = values(at)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(at, toxicity.fit(at, labels), "score").collect()
    kept = stages["toxicity"](spark, at, folder).cache()
    assert kept.columns == NAMES
    assert values(kept) == Counter(tuple(r[c] for c in NAMES) for r in scored if r.score < toxicity.THRESHOLD)
    gone = {r[0] for r in given - values(kept)}
    assert len([d for d in gone if d is not None and 2000 <= d < 2060]) >= 55
    assert not gone & {r[0] for r in given if r[0] is not None and r[0] < 2000 and len(words(r[1])) >= 20}

    lines = stages["line_dedup"](spark, kept, folder).cache()
    assert lines.columns == NAMES and values(lines) == after_lines(values(kept))
    assert not any("subscribe" in (r[1] or "") for r in values(lines))

    near = stages["near_dedup"](spark, lines, folder).cache()
    assert near.columns == NAMES and values(near) == after_near(values(lines))
    assert near.where("doc_id = 3101").count() == 2 and near.count() < lines.count()

    mixed = stages["mixing"](spark, near, folder).cache()
    before, after = values(near), values(mixed)
    assert mixed.columns == NAMES and set(before) == set(after) and all(after[r] >= n and after[r] % n == 0 for r, n in before.items())
    size = Counter()
    for r, n in before.items():
        size[r[3]] += n * len(words(r[1]))
    top = max(size, key=size.get)
    assert all(after[r] == n for r, n in before.items() if r[3] == top)

    packed = stages["packing"](spark, mixed, folder).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in by.values())
    docs = Counter(r.doc_id for r in mixed.collect())
    assert set(whole) == set(docs) and all(sum(r.doc_tokens for r in packed if r.doc_id == d and r.start == 0) == n for d, n in whole.items())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
