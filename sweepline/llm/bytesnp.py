"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, span hashes, segments."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BLOCK = 1 << 20


def slices(column: pa.Array, most: int = BLOCK):
    """(first row, last row, bytes, offsets) of runs of rows with about ``most`` bytes; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = "<i8"
    else:
        wide = "<i4"
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(off, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def fold_case(b: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` and, by document, the index of its first word (n + 1 values)."""
    inside = ~_SPACE[b]
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = np.zeros(len(b) + 1, bool)
    first[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = U(pow(int(STEP), -1, 1 << 64))
        up, down = np.full(size, STEP, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Spans:
    """Equal bytes, equal 64-bit hash, for any spans of ``b``, after one prefix sum."""

    def __init__(self, b: np.ndarray, seed: int = 11):
        # one pair of tables is kept; longer texts have their own for a while
        self.up, self.down = _powers(BLOCK + 1) if len(b) <= BLOCK else _powers.__wrapped__(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, U)
        np.cumsum(byte_codes(seed)[b] * self.up[: len(b)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def every(self, width: int) -> np.ndarray:
        """Of all spans of ``width`` bytes, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
