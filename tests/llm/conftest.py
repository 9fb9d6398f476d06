import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, n long, copies string, queue int, d int"


def words(text):
    return WORD.findall(text or "")


def invented(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(texts, source=lambda i: f"s{i % 3}"):
    """Documents with columns whose names clash with the operators' own."""
    return [(i, t, "en", source(i), len(t or ""), "x", 7, "y", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Base texts, exact and near copies, shared passages, and odd ones."""
    rng = random.Random(5)
    base = [invented(rng, rng.choice([3, 20, 80, 160])) for _ in range(24)]
    out = list(base)
    passage = invented(rng, 70)
    for t in base[:12]:
        w = t.split()
        out.append(t)
        if len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
            out.append(" ".join(w[:10]) + " " + passage + "\n" + " ".join(w[10:]))
    out += [None, "", "  \n\t ", "one", "ONE", "two words", "É ü 漢字 \U0001f600 </s>[INST]", "a" * 5000, "la " * 3000, invented(rng, 9000), "x\x00y \x0b z", passage, "end <|endoftext|> of text"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    odd = [(None, texts[0], None, None, None, None, None, None, None, None), (3, texts[3], "en", None, 1, "x", 1, "z", 1, 1), (None, None, None, "s0", None, None, None, None, None, None)]
    return spark.createDataFrame(rows(texts) + odd, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
