"""Vectorised splitting and hashing of words in Arrow batches; small helpers of the kernels that Spark runs per partition.

Words are runs of bytes of a class. Both classes used here keep every byte of
a multi-byte UTF-8 character, so byte runs and code point runs are the same.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROLL = 0xD6E8FEB86659FD93
#: The low bytes of a lane of eight that a run still has.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Every byte but the white space 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, a-z and all bytes of other than ASCII characters; for text in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """Words of a column: bytes, starts and ends in them, and the index of each row's first word (one more for the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def pieces(batches, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has at most ``limit`` bytes of a text column, or one row: memory stays bounded."""
    for batch in batches:
        sizes = np.diff(offsets(batch.column(column))[0])
        lo = 0
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """Returns freed memory of a task to the system, so that reused workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def split(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    at, data = offsets(column)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run (none empty).

    Lanes of eight bytes are mixed with their place and summed, so that no
    order of the same bytes is alike by its form; runs of one lane and equal
    size have equal hashes only if they are equal.
    """
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    total = mix(lane[starts] & _MASK[np.minimum(sizes, 8)])
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3
        j = ragged(np.ones(len(long), np.int64), more)
        value = lane[np.repeat(starts[long], more) + 8 * j] & _MASK[np.minimum(np.repeat(sizes[long], more) - 8 * j, 8)]
        total[long] += np.add.reduceat(mix(value + j.astype(np.uint64) * _STEP), np.cumsum(more) - more)
    return mix(total + sizes.astype(np.uint64))


def hashes(words: Words) -> np.ndarray:
    return run_hashes(words.data, words.starts, words.ends)


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each ``n`` consecutive values, by doubling; blind to rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    factor = np.uint64((_ROLL + 2 * salt) % 2**64)
    block, size, out, have = h, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:
                m = len(h) - have - size + 1
                out = mix(out[:m] * factor + block[have : have + m])
                have += size
        if have == n:
            return mix(out + np.uint64(n))
        m = len(h) - 2 * size + 1
        block = mix(block[:m] * factor + block[size : size + m])
        size *= 2


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one run after the other."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)
