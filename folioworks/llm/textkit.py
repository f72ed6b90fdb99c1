"""Words and hashes of whole Arrow batches of texts, as numpy arrays over the texts' bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit and
depend on nothing but the bytes, so every task names equal words alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone, whole.
BLOCK = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


class Block(NamedTuple):
    rows: slice
    data: np.ndarray  # bytes of these rows' texts
    off: np.ndarray  # row r is data[off[r]:off[r+1]]


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # row r has words first[r]:first[r+1]


def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The batch in runs of rows of about so many bytes."""
    if pc.any(texts.is_null()).as_py():
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield Block(slice(row, stop), raw[off[row] : off[stop]], off[row : stop + 1] - off[row])
        row = stop


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(off), np.int64))
    inside = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, off))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span's bytes, eight bytes at a time."""
    size = end - start
    out = mix(size.astype(np.uint64) + u64(seed * 0x9E3779B97F4A7C15 + 1))
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))
    live, at, left = None, start, size
    while True:
        got = eight[at] & _TAIL[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ got)
            live = np.flatnonzero(left > 8)
        else:
            out[live] = mix(out[live] ^ got)
            live = live[left > 8]
        if not len(live):
            return out
        done = (at[left > 8] + 8, left[left > 8] - 8)
        at, left = done


def grams(h: np.ndarray, first: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every n consecutive words of one row; a row's position is its word's."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = len(h) - n + 1
    out = np.full(size, u64(seed * 0x2545F4914F6CDD1D + n), np.uint64)
    for j in range(n):
        out = out * u64(0x9E3779B97F4A7C15 | 1) + h[j : j + size]
    ok = np.ones(size, bool)
    for j in range(1, n):  # no gram crosses into the next row
        edge = first[1:-1] - j
        ok[edge[(edge >= 0) & (edge < size)]] = False
    at = np.flatnonzero(ok)
    return at, mix(out[at])


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column: row r has the next sizes[r] values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), longs(values))
