"""Reader of unlabelled tag-length-value messages, over whole Arrow binary columns.

All messages advance together, one field a step: tags and numbers are read by numpy over the
cursors of the messages that still lack a wanted field. A message that is malformed keeps what
stood before the fault. Of a repeated field the first counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
VARINT_BYTES = 10


class Spans(NamedTuple):
    """Byte ranges in one buffer; a range that is not there is empty and not ``known``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: np.ndarray


def spans(column: pa.Array) -> Spans:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return Spans(data, offsets[:-1].copy(), offsets[1:].copy(), column.is_valid().to_numpy(zero_copy_only=False))


def read_varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, next place, well-formed) of the number at each place; ten bytes at most."""
    value, place, fine, open_ = np.zeros(len(at), U), at.copy(), np.zeros(len(at), bool), np.ones(len(at), bool)
    for k in range(VARINT_BYTES):
        now = np.flatnonzero(open_ & (place < end))
        if not len(now):
            break
        byte = data[place[now]]
        value[now] |= (byte & 127).astype(U) << U(7 * k)
        place[now] += 1
        last = byte < 128
        fine[now[last]] = True
        open_[now[last]] = False
    return value, place, fine


def fields(message: Spans, numbers: tuple[int, ...] = (), parts: tuple[int, ...] = ()) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, Spans]]:
    """The first number of each field in ``numbers`` (value, known), and the first part of each in ``parts``.

    A fixed-width value counts as the number 0.
    """
    n = len(message.start)
    got = {f: (np.zeros(n, U), np.zeros(n, bool)) for f in numbers}
    found = {f: Spans(message.data, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)) for f in parts}
    row = np.flatnonzero(message.known & (message.start < message.end))
    at, end = message.start[row], message.end[row]
    while len(row):
        tag, at, fine = read_varints(message.data, at, end)
        kind, field = (tag & U(7)).astype(np.int64), tag >> U(3)
        value, place, read = read_varints(message.data, at, end)
        room = (end - at).astype(np.float64)
        width = np.select([kind == 1, kind == 5], [8, 4], 0)
        number = (kind == 0) & read
        fixed = (width > 0) & (width <= room)
        part = (kind == 2) & read & (value.astype(np.float64) <= (end - place).astype(np.float64))
        fine &= number | fixed | part
        length = np.where(part, value, U(0)).astype(np.int64)
        after = np.where(fixed, at + width, place + length)
        for f in numbers:
            hit = fine & (number | fixed) & (field == U(f)) & ~got[f][1][row]
            got[f][0][row[hit]] = np.where(number[hit], value[hit], U(0))
            got[f][1][row[hit]] = True
        for f in parts:
            hit = fine & part & (field == U(f)) & ~found[f].known[row]
            found[f].start[row[hit]], found[f].end[row[hit]] = place[hit], after[hit]
            found[f].known[row[hit]] = True
        lacking = np.zeros(len(row), bool)
        for f in numbers:
            lacking |= ~got[f][1][row]
        for f in parts:
            lacking |= ~found[f].known[row]
        go = fine & (after < end) & lacking
        row, at, end = row[go], after[go], end[go]
    return got, found


def texts(part: Spans, most: int | None = None) -> pa.Array:
    """The parts as text; null where it is longer than ``most`` bytes or no UTF-8."""
    size = part.end - part.start
    known = part.known & (size <= most) if most is not None else part.known
    size = np.where(known, size, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = part.data[np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(part.start, size)]
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    try:
        out = raw.cast(pa.large_string()).to_pylist()
    except pa.ArrowInvalid:
        out = [_text(x) for x in raw.to_pylist()]
    return pa.array([x if k else None for x, k in zip(out, known.tolist(), strict=True)], pa.string())


def _text(x: bytes) -> str | None:
    try:
        return x.decode()
    except UnicodeDecodeError:
        return None
