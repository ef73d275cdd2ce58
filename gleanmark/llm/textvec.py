"""Vectorised word splitting and hashing over Arrow string columns.

The functions work on the UTF-8 bytes of a whole Arrow batch at once. A word is a maximal run of
bytes other than space and 0x09..0x0D. Hashes are 64-bit polynomial sums over random byte values,
finished with a multiply-xorshift mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the words of a shingle, by place.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


@dataclass
class Words:
    data: np.ndarray  # bytes
    offsets: np.ndarray  # rows in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    row: np.ndarray  # of each word
    first: np.ndarray  # n + 1: where each row's words begin among all words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array) -> Words:
    data, offsets = flat(column)
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(n + 1, np.int64))
    space = SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, np.repeat(np.arange(n), np.diff(first)), first)


def word_hashes(w: Words, folded: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``folded`` takes A-Z as a-z."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    tail = w.data[w.starts[0] :]
    begin = w.starts - w.starts[0]
    place = np.arange(len(tail)) - np.repeat(begin, np.diff(np.append(begin, len(tail))))
    values = (_FOLDED if folded else _BYTE)[tail] * _power(int(place.max()) + 1)[place]
    # Spaces count nothing, so that a sum up to the next word's start is the word's own.
    return mix(np.add.reduceat(values, begin) + (w.ends - w.starts).astype(np.uint64))


def shingles(w: Words, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and the row of each, in order.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    n = np.maximum(counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.first[:-1], n)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += hashes[at + j] * _PLACE[j]
    total = mix(total)
    if len(short):
        few = np.array([(hashes[w.first[r] : w.first[r + 1]] * _PLACE[size : size + counts[r]]).sum(dtype=np.uint64) for r in short], dtype=np.uint64)
        rows, total = np.append(rows, short), np.append(total, mix(few))
        order = np.argsort(rows, kind="stable")
        rows, total = rows[order], total[order]
    return total, rows


def sets(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within it, and the n + 1 offsets of the rows."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    out, sizes = [], np.zeros(n, np.int64)
    for r in range(n):
        part = np.unique(values[bounds[r] : bounds[r + 1]])
        sizes[r] = len(part)
        out.append(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
