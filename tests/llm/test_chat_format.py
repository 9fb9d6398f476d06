import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from meterlake.llm import chat_format

PIECES = st.sampled_from(["<|", "<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<|end|>\n", "<|turn|>", "\n", "a", "é", "[", "/SYS>>", "INST]", "s>"])
TEXT = st.lists(PIECES, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_round_trip(turns):
    roles, texts = (pa.array([t[i] for t in turns]).cast(pa.large_string()) for i in (0, 1))
    out, offsets, role_chars, text_chars = chat_format.assemble(roles, texts)
    text = out.tobytes().decode()
    assert chat_format.parse(text) == turns
    assert len(text) == int(role_chars.sum() + text_chars.sum()) + 17 * len(turns) and offsets[-1] == len(out)


def test_digests(spark):
    rows = [(1, 1, "assistant", "b <|end|>"), (1, 0, "user", "a"), (2, 0, None, None), (3, None, "assistant", "first"), (3, 0, "assistant", "é\U0001f600</s>"), (None, 0, "user", "x"), (1, 1, "assistant", "b <|end|>")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i} " * 50) for i in range(3000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, 3, 9, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(frame)).count() == 0
