"""Words and word n-grams of whole text batches as numpy arrays of 64-bit hashes.

A batch is the UTF-8 buffer of an Arrow string column plus its offsets, so no
Python loop runs over words. Hashes are polynomial sums modulo 2**64 over random
per-byte values, finished with an avalanche mix; equal words (after the class's
case folding) always have equal hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BLOCK = 512 << 10  # bytes hashed at a time


class WordClass(NamedTuple):
    """Which bytes belong to words, and what each byte counts as."""

    member: np.ndarray  # bool[256]
    value: np.ndarray  # uint64[256]


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def spaced_words(fold: bool = False) -> WordClass:
    """Words are runs without white space; ``fold`` lower-cases A to Z."""
    member = np.ones(256, bool)
    member[[9, 10, 11, 12, 13, 32]] = False
    value = _byte_values()
    if fold:
        value[65:91] = value[97:123]
    return WordClass(member, value)


def letter_words() -> WordClass:
    """Words are runs of 0-9, a-z and non-ASCII characters; A to Z are folded."""
    member = np.zeros(256, bool)
    member[48:58] = member[65:91] = member[97:123] = True
    member[128:] = True
    value = _byte_values()
    value[65:91] = value[97:123]
    return WordClass(member, value)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (multiply, shift and xor rounds)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=U)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def volume(column: pa.Array) -> int:
    """Bytes of text of a string column, with a share for every row."""
    return int(pc.sum(pc.binary_length(column)).as_py() or 0) + 64 * len(column)


def slices(column: pa.Array, budget: int) -> list[tuple[int, int]]:
    """(start, length) of runs of rows with about ``budget`` bytes of text each; a longer
    text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    out, at = [], 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + budget, "right")))
        out.append((at, end - at))
        at = end
    return out


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one a word, in text order
    start: np.ndarray  # byte offsets into the batch's buffer
    end: np.ndarray
    first: np.ndarray  # first[d] .. first[d + 1] are the words of text d

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Words:
    """All words of all texts of a batch; a word never spans two texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64))
    cut = np.append(np.arange(0, len(buf), _BLOCK), len(buf))
    cut = np.unique(offsets[np.searchsorted(offsets, cut)])  # blocks end where texts end
    cut = np.unique(np.append(cut, [0, len(buf)]))
    power = _powers(_BASE, int(np.diff(cut).max()) + 1)
    inverse = _powers(_inverse(_BASE), len(power))
    hashes, starts, ends = [], [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = buf[a:b]
        inside = kind.member[part]
        edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        edge = edge[edge < len(part)]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[edge] = False
        s = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        e = np.flatnonzero(inside & ~after) + 1
        total = np.empty(len(part) + 1, U)
        total[0] = 0
        np.cumsum(kind.value[part] * power[: len(part)], dtype=U, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U)))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all runs of n words inside one text; a position is
    the index of the run's first word in the batch."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sums = np.empty(total + 1, U)
    sums[0] = 0
    np.cumsum(w.hash * _powers(_GRAM, total), dtype=U, out=sums[1:])
    length = np.diff(w.first)
    last = np.repeat(w.first[1:], length)  # end of the text of each word
    at = np.arange(total)
    at = at[at + n <= last]
    h = (sums[at + n] - sums[at]) * _powers(_inverse(_GRAM), total)[at]
    return mix(h + U(n)), at


def codes(buf: np.ndarray, w: Words, dictionary: pa.Array | None = None) -> tuple[np.ndarray, pa.Array]:
    """(a number for each word, the distinct words): equal words, and only those, have
    equal numbers. Given a dictionary, words that it lacks get -1."""
    size = w.end - w.start
    offsets = np.append(0, np.cumsum(size))
    inside = np.repeat(w.start - offsets[:-1], size) + np.arange(offsets[-1])
    text = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[inside]))])
    if dictionary is None:
        coded = text.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    return pc.fill_null(pc.index_in(text, value_set=dictionary), -1).to_numpy(zero_copy_only=False), dictionary
