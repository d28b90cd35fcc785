"""Vectorised work on the bytes of many texts at once (numpy on Arrow buffers, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one longer text is a chunk of its own.
CHUNK = 1 << 19
#: Odd multipliers of the polynomial hashes, and the byte codes they sum.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of BASE and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(n, 2 * len(self.values), CHUNK + 1)
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values[:n]


POWERS = _Powers(BASE)
INVERSE = _Powers(pow(BASE, -1, 1 << 64))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; a null text has no bytes."""
    flat = column.cast(pa.large_binary())
    _, bounds, body = flat.buffers()
    n = len(flat)
    offsets = np.frombuffer(bounds, dtype=np.int64)[flat.offset : flat.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial sum over the first i bytes; (H[e] - H[s]) * INVERSE[s] hashes bytes s to e."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(CODES[data] * POWERS.upto(len(data)), out=out[1:])
    return out


def runs_hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch of bytes."""
    h = prefix_hashes(data)
    return mixed((h[ends] - h[starts]) * INVERSE.upto(len(data) + 1)[starts])


def word_bounds(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run of bytes of one non-zero kind inside one text."""
    n = len(kind)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    proper = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[proper], ends[proper]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counts_by_text(of: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(of, minlength=texts)
