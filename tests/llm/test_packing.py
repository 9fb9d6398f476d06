import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from meterlake.llm import packing
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_token_lies_in_one_piece(docs, texts, tokenizer):
    rows = packing.pack(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = sorted(ids * (2 if i == 3 else 1))
        got = sorted(x for r in by_doc[i] for x in np.frombuffer(r.ids, "<u4").tolist())
        assert got == want and all(r.doc_tokens == len(ids) for r in by_doc[i])
        if i != 3:
            assert [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    total = sum(r.length for r in rows)
    assert len(by_seq) <= total // packing.LENGTH + 2
    row = rows[0]
    d = packing.digest(packing.pack(docs)).where(f"doc_id = {row.doc_id} and start = {row.start}").first() if row.doc_id not in (None, 3) else None
    assert d is None or d.ids_crc32 == zlib.crc32(row.ids)


def one_by_one(quanta):
    """Deficit round-robin quantum by quantum: at each halving a counter tells which side is due."""
    sums = np.concatenate([[0], np.cumsum(quanta)])
    seen = defaultdict(int)
    for _ in range(int(sums[-1])):
        lo, hi = 0, len(quanta)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left, both = int(sums[mid] - sums[lo]), int(sums[hi] - sums[lo])
            n = seen[lo, hi]
            seen[lo, hi] += 1
            lo, hi = (lo, mid) if (n + 1) * left // both > n * left // both else (mid, hi)
        yield lo


def test_plan_equals_deficit_round_robin():
    plan = packing.Plan([packing.QUANTUM * n for n in (137, 1, 60, 391, 9)])
    line = list(one_by_one(plan.quanta))
    for q in range(5):
        x = np.arange(len(line) + 1)
        before, own = plan.served(np.full(len(x), q), x)
        assert own.tolist() == [0, *np.cumsum([v == q for v in line]).tolist()]
        assert before.tolist() == [0, *np.cumsum([v < q for v in line]).tolist()]
        at = [i // packing.PER_WINDOW for i, v in enumerate(line) if v == q]
        assert plan.window(np.full(len(at), q), np.arange(len(at))).tolist() == at


def test_windows_keep_the_proportions():
    plan = packing.Plan([packing.QUANTUM * n for n in (1000, 600, 390, 10)])
    for q, t in enumerate(plan.tokens):
        x = np.arange(0, int(plan.begin[-1]) + 1, packing.PER_WINDOW)
        served = plan.served(np.full(len(x), q), x)[1] * packing.QUANTUM
        assert (np.diff(served) >= 0).all()
        assert np.abs(served - x * packing.QUANTUM * t / plan.tokens.sum()).max() <= 2 * packing.QUANTUM


def test_target_weights_hold_until_a_queue_is_empty():
    quanta = [900, 300, 300]
    plan = packing.Plan([packing.QUANTUM * n for n in quanta], [1.0, 1.0, 2.0])
    own = np.array([plan.served(np.full(5, q), np.array([0, 240, 600, 900, 1500]))[1] for q in range(3)])
    assert (own.sum(axis=0) == [0, 240, 600, 900, 1500]).all() and own[:, -1].tolist() == quanta
    assert np.abs(own[:, 1] - [60, 60, 120]).max() <= 2 and np.abs(own[:, 2] - [150, 150, 300]).max() <= 2 and np.abs(own[:, 3] - [300, 300, 300]).max() <= 2


def test_weights_and_many_sources(spark, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 40 + 1), f"s{i % 90}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, weights in ((packing.MAX_QUEUES, {f"s{i}": 1.0 + i for i in range(90)}), (packing.MAX_QUEUES, None), (7, None)):
        monkeypatch.setattr(packing, "MAX_QUEUES", most)
        monkeypatch.setattr(packing, "BLOCK_BYTES", 2000)
        seqs, docs_ = defaultdict(list), defaultdict(list)
        for r in packing.pack(frame, weights=weights).collect():
            seqs[r.sequence_id].append((r.offset, r.length))
            docs_[r.doc_id].append((r.start, r.length, r.doc_tokens))
        for pieces in seqs.values():
            assert [a for a, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1].tolist()]
        for pieces in docs_.values():
            assert [a for a, *_ in sorted(pieces)] == [0, *np.cumsum([n for _, n, _ in sorted(pieces)])[:-1].tolist()] and sum(n for _, n, _ in pieces) == pieces[0][2]
        assert len(docs_) == 400 and sorted(seqs) == list(range(len(seqs)))


def test_share_is_exact_for_large_numbers():
    x = np.array([0, 1, (1 << 39) + 12345, (1 << 40) - 3])
    whole, part = (1 << 40) - 1, (1 << 39) + 7
    assert packing.share(x, part, whole).tolist() == [int(v) * part // whole for v in x]


def test_ids_equal_the_json_vocabulary(tokenizer):
    enc = packing.encoder()
    for t in ("", " a  b\n\n c", "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext", "naïve 漢字 \U0001f600\x00", "la " * 500, "a" * 3000):
        assert enc.encode(t, allowed_special="all") == tokenizer.encode(t, add_special_tokens=False).ids


def test_empty(empty):
    assert packing.pack(empty).count() == 0
