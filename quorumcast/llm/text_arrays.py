"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes of windows.

Everything here works on a whole batch at once and knows nothing of Spark.
Hashes are polynomials over random byte values modulo 2**64, finished with a
mixing step; equal inputs give equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS_AT_ONCE = 1 << 18

#: Bytes that separate plain words: space and 9 to 13.
PLAIN = np.ones(256, bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``most_bytes`` of text; yield each with
    its text bytes and row offsets.  NULL counts as empty.  A longer text stands alone."""
    if batch.num_rows == 0:
        return
    data, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        upto = min(upto, batch.num_rows)
        yield batch.slice(at, upto - at), data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at]
        at = upto


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column, NULL as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    _, offsets, data = binary.buffers()
    n = len(binary)
    offsets = np.frombuffer(offsets, np.int64, n + 1, binary.offset * 8) if n else np.zeros(1, np.int64)
    size = int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, size) if size else np.zeros(0, np.uint8)
    return raw[offsets[0]:], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``kept`` bytes inside a row, and the
    row offsets in words."""
    inside = kept[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; works through the words in bounded pieces."""
    out = np.empty(len(starts), np.uint64)
    up = down = np.zeros(0, np.uint64)
    for a in range(0, len(starts), _WORDS_AT_ONCE):
        b = min(a + _WORDS_AT_ONCE, len(starts))
        lo, hi = int(starts[a]), int(ends[b - 1])
        if hi - lo > len(up):
            up, down = _powers(_BASE, hi - lo), _powers(_INVERSE, hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (rows are not looked at)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_STEP)
        out += h[j:j + n]
    return mix(out)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every item, given row offsets in items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal true runs that do not cross row offsets."""
    if len(mask) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi, _ = words(mask.view(np.uint8), offsets, _TRUE)
    return lo, hi


_TRUE = np.zeros(256, bool)
_TRUE[1] = True


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of an integer or boolean array per row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
