import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from meterlake.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """(item, rank) to (doc_id, score); ties of repeated doc_ids are equal."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    size = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    merged = {}
    for key, text in items:
        merged.setdefault(key, []).extend(terms(text))
    for key, words in merged.items():
        asked, scores = Counter(words), []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n) // size if size else 0
            s = sum(times * floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 12 * m)) for w, times in asked.items() if w in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[key, rank] = (i, -s)
    return out


def found(spark, docs, items, shard_bytes=ls.SHARD_BYTES, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    index, corpus = ls.build_index(d, shard_bytes)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in ls.search(index, corpus, q, k=k).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeéz0") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(700)]
    docs += [(800 + i, docs[5][1]) for i in range(30)]  # ties
    docs += [(1, docs[3][1]), (None, docs[5][1]), (900, None), (901, ""), (902, "... !"), (903, "É漢字 \U0001f600x, ABC-abc"), (904, "q" * 3000), (905, text(60_000)), (906, "\x00a\x7fb")]
    items = [(n, text(12)) for n in range(20)] + [(50, None), (51, "nowhere-found ,"), (52, docs[5][1]), (53, "É漢字 abc ABC"), (None, text(3)), (2, text(4)), (54, "a a a b")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [ls.SHARD_BYTES, 3000])
def test_search_equals_brute_force(spark, corpus, shard_bytes):
    docs, items = corpus
    want = brute(docs, items)
    assert found(spark, docs, items, shard_bytes) == want and len(want) > 300


def test_small_groups_of_items_and_shuffled_terms(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ls, "ITEMS", 3)
    monkeypatch.setattr(ls, "BROADCAST_TERMS", 0)
    assert found(spark, docs[:200], items, 2000, k=5) == brute(docs[:200], items, k=5)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == {} and found(spark, docs[:20], []) == {} and found(spark, [(1, None), (2, " ")], items) == {}


def test_numbers_round_trip():
    rng = random.Random(1)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, *[rng.randrange(1 << rng.randint(1, 50)) for _ in range(500)]])
    data, ends = ls.pack_numbers(values)
    assert (ls.unpack_numbers(data) == values).all() and ends[-1] == len(data) and (data[ends - 1] < 128).all()
    assert len(ls.unpack_numbers(np.empty(0, np.uint8))) == 0


def test_blocks_below_the_threshold_stay_packed(spark):
    """A rare term's few documents set the threshold; the frequent term's other blocks stay closed."""
    docs = [(i, "often " + ("rare " * 3 if i in (700, 701) else "x" * (i % 50))) for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index, corpus = ls.build_index(d)
    rows = index.where("term in ('often', 'rare') or term is null").collect()
    opened = []
    for r in rows:
        if r.term is None:
            packed = np.asarray(r.docs)
    posts = [(ls.Postings(r.asDict() | {"weight": 1 if r.term == "often" else 9000}), 1) for r in rows if r.term is not None]
    for p, _ in posts:
        own = p.open
        p.open = lambda blocks, m, own=own: (opened.append(len(blocks)), own(blocks, m))[1]
    best = ls.Best(2)
    ls.search_shard(posts, packed, best)
    blocks = sum(len(p.ends) for p, _ in posts)
    assert best.rows[1].tolist() == [700, 701] and blocks > 40
    assert sum(len(p.held) for p, _ in posts) <= ls.OPEN + 2 < blocks


def test_long_text_without_separators_is_one_term(spark):
    assert found(spark, [(1, "z" * (3 << 20) + " end"), (2, "end")], [(0, "END")]) == brute([(1, "z" * (3 << 20) + " end"), (2, "end")], [(0, "END")])
