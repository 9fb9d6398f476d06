"""Vectorised text kernels: whole Arrow batches as byte arrays, no loop per word.

Words are maximal runs of bytes outside space and ``\\t``-``\\r``. Word hashes are
multilinear over the word's bytes with one random 64-bit factor per byte position,
so two different words collide with probability of about 2**-57 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors that depend on the seed and the position only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + mix(np.array([seed], U))) | U(1)


_FACTORS: dict[int, np.ndarray] = {}


def factors(n: int, seed: int) -> np.ndarray:
    held = _FACTORS.get(seed)
    if held is None or len(held) < n:
        held = randoms(max(256, 1 << int(n).bit_length()), seed)
        if len(held) <= 1 << 16:
            _FACTORS[seed] = held
    return held


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after the other
    starts: np.ndarray  # first byte of each word
    lengths: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]


def text_array(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts a batch into row slices of about ``most`` bytes of text (a longer text stands alone)."""
    texts = text_array(batch.column(batch.schema.get_field_index(column)))
    if not len(texts):
        return
    _, offsets = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[1:] = space[:-1]
    before[edges] = True
    after = np.empty(n, bool)
    after[:-1] = space[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends - starts, np.searchsorted(starts, offsets))


def word_hashes(words: Words, seed: int = 1) -> np.ndarray:
    if not len(words.starts):
        return np.empty(0, U)
    heads = np.concatenate([[0], np.cumsum(words.lengths)[:-1]])
    place = np.arange(int(words.lengths.sum()), dtype=np.int64) - np.repeat(heads, words.lengths)
    where = place + np.repeat(words.starts, words.lengths)
    with np.errstate(over="ignore"):
        parts = (words.data[where].astype(U) + U(1)) * factors(int(words.lengths.max()), seed)[place]
        return mix(np.add.reduceat(parts, heads) + words.lengths.astype(U))


def ngrams(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of each run of n hashes (runs across texts included; callers mask them)."""
    if len(hashes) < n:
        return np.empty(0, U)
    f = factors(n, seed)
    with np.errstate(over="ignore"):
        total = hashes[: len(hashes) - n + 1] * f[0]
        for j in range(1, n):
            total += hashes[j : len(hashes) - n + 1 + j] * f[j]
    return mix(total)


def rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of n hashes, by prefix sums; cost doesn't depend on n."""
    if len(hashes) < n:
        return np.empty(0, U)
    b = U(base | 1)
    inverse = U(pow(int(b), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[U(1)], np.full(len(hashes) - 1, b, U)]))
        back = np.cumprod(np.concatenate([[U(1)], np.full(len(hashes) - n, inverse, U)]))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * powers)])
        return mix((sums[n:] - sums[:-n]) * back)


def window_extreme(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each run of ``width`` values, by doubling."""
    f = np.minimum if least else np.maximum
    out, span = values, 1
    while span * 2 <= width:
        out = f(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def shingle_sets(texts: pa.Array, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: (hashes, bounds).

    A text with 1 to size - 1 words has its whole sequence as the one shingle.
    """
    words = split_words(texts, lower)
    hashes = word_hashes(words)
    grams = ngrams(hashes, size)
    f = factors(size, 7)
    sets = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                sets.append(mix(np.array([(hashes[a:b] * f[: b - a]).sum(dtype=U) + U(0xA5A5 + b - a)], U)))
        else:
            sets.append(np.empty(0, U))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, U)), bounds


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
