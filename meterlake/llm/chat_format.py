"""Chat formatting by columnar byte assembly.

The template of a turn is ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside
roles and texts (``<|``, ``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``<<SYS>>``,
``<</SYS>>``) get a backslash after their first character; where backslashes already
stand there, one more. Line feeds and backslashes in a role are written ``\\n`` and
``\\\\``. Both steps are undone by :func:`read_back`.

Conversations are dealt by conv_id and sorted by turn, then streamed: each Arrow batch
is assembled into one preallocated buffer. A conversation of any length passes through
in parts (conv_id, part, formatted, loss spans), in order, in one partition; no task
holds more than a batch. The loss mask covers the text of assistant turns.

Defined cases: a null role or text is empty; a null turn comes first; rows with the same
turn are ordered by role, then text; rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import _kernels as K
from meterlake.llm._spark import over_arrow

CONTROL = r"([<\[])(\\*)(\||/?INST\]|/?s>|</?SYS>>|/SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?INST\]|/?s>|</?SYS>>|/SYS>>)"
OPEN, MIDDLE, CLOSE = b"<|turn|>", b"\n", b"<|end|>\n"
PARTS = "conv_id long, part int, formatted string, n_turns int, loss array<struct<start:int,length:int>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def _role(roles: pa.Array) -> pa.Array:
    plain = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(plain)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Copies consecutive runs of ``data`` to the places ``to`` of ``out``."""
    begin = np.cumsum(lengths) - lengths
    out[np.arange(len(data)) + np.repeat(to - begin, lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; byte offsets of the turns; character lengths of turn and text."""
    roles, texts = _role(roles), escape(texts)
    (role_data, role_at), (text_data, text_at) = K.raw(roles), K.raw(texts)
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    whole = role_len + text_len + len(OPEN) + len(MIDDLE) + len(CLOSE)
    offsets = np.concatenate([[0], np.cumsum(whole)])
    out = np.empty(int(offsets[-1]), np.uint8)
    head = offsets[:-1]
    for mark, at in ((OPEN, head), (MIDDLE, head + len(OPEN) + role_len), (CLOSE, offsets[1:] - len(CLOSE))):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, head + len(OPEN), role_data, role_len)
    _scatter(out, head + len(OPEN) + role_len + len(MIDDLE), text_data, text_len)
    role_chars = pc.utf8_length(roles).to_numpy(zero_copy_only=False).astype(np.int64)
    text_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return out, offsets, role_chars, text_chars


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        for rows, texts in K.sliced(batch, "text"):
            conv = rows.column(0).to_pylist()
            roles = K.text_array(rows.column(1))
            out, offsets, role_chars, text_chars = assemble(roles, texts)
            assistant = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
            heads = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
            fixed = len(OPEN) + len(MIDDLE) + len(CLOSE)
            ends = np.cumsum(role_chars + text_chars + fixed)
            begin = ends - text_chars - len(CLOSE)
            made = {k: [] for k in ("conv_id", "part", "n_turns", "loss")}
            for a, b in zip(heads, [*heads[1:], len(conv)], strict=True):
                part = part + 1 if conv[a] == last else 0
                last = conv[a]
                zero = int(ends[a - 1]) if a else 0
                made["conv_id"].append(conv[a])
                made["part"].append(part)
                made["n_turns"].append(b - a)
                made["loss"].append([{"start": int(begin[i]) - zero, "length": int(text_chars[i])} for i in range(a, b) if assistant[i]])
            cuts = offsets[np.array([*heads, len(conv)])].astype(np.int32)
            text = pa.StringArray.from_buffers(len(heads), pa.py_buffer(cuts), pa.py_buffer(out))
            loss = pa.array(made["loss"], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            yield pa.record_batch(
                [pa.array(made["conv_id"], pa.int64()), pa.array(made["part"], pa.int32()), text, pa.array(made["n_turns"], pa.int32()), loss],
                ["conv_id", "part", "formatted", "n_turns", "loss"],
            )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Parts of formatted conversations; the parts of one conversation follow each other in a partition."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").transform(over_arrow, _format, PARTS)


TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)
_ROLE = re.compile(r"\\(\\|n)")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted part."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        turns.append((_ROLE.sub(lambda x: "\n" if x[1] == "n" else "\\", unescape(m[1])), unescape(m[2])))
        at = m.end()
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: list = []

    def row() -> dict:
        conv, n, turns, loss_n, loss, chars = state
        return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_n, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        done = []
        for i in range(len(batch)):
            conv, part, text, loss = (batch.column(k)[i].as_py() for k in (0, 1, 2, 4))
            if part == 0:
                if state:
                    done.append(row())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["start"] + span["length"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        yield pa.RecordBatch.from_pylist(done, schema)
    if state:
        yield pa.RecordBatch.from_pylist([row()], schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the output of :func:`format_conversations` alone."""
    return parts.transform(over_arrow, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?INST\]|/?s>|</?SYS>>|/SYS>>)', '\1\\\2\3', 'g') AS et,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(\||/?INST\]|/?s>|</?SYS>>|/SYS>>)', '\1\\\2\3', 'g') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + length(er) + 17)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
