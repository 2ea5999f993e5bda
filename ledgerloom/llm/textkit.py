"""Vectorised work on the bytes of many texts, for use inside Arrow tasks.

A slice of texts is handled as one byte array with document offsets.  Hashes of
any substring come from prefix sums of a polynomial modulo 2**64, so a word, a
window or a whole document costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
U64 = np.uint64
# Odd base: invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the n + 1 offsets of its rows; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.empty(size, U64)
        out[0], done, step = 1, 1, base
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U64(step)
            step = step * step % (1 << 64)
            done += take
        return out

    return of(_BASE), of(_BASE_INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``size`` of each."""
    return _powers(max(1 << 22, 1 << int(size).bit_length()) + 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of the polynomial hash of ``data``."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and the row it belongs to."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[0::2], change[1::2]
    # A run that goes over the end of a row is two words.
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):
        at = np.searchsorted(starts, cuts, side="right") - 1
        crossing = cuts[(at >= 0) & (starts[at] < cuts) & (ends[at] > cuts)]
        if len(crossing):
            crossing = np.unique(crossing)
            starts = np.sort(np.concatenate([starts, crossing]))
            ends = np.sort(np.concatenate([ends, crossing]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased (A-Z) word, in text order, and its row."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(prefix_sums(lower_ascii(data)), starts, ends), rows


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets into ``rows`` (ascending row numbers)."""
    return np.searchsorted(rows, np.arange(n + 1))
