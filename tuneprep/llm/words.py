"""Words of whole texts as numpy arrays, one Arrow batch at a time.

Words are runs of bytes other than the ASCII white space space, \\t, \\n, \\v, \\f, \\r.
Their 64-bit hashes are sums of random byte values times powers of an odd number, so
a batch is hashed by a handful of array operations instead of word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# For matching prose: words are runs of ASCII letters, digits and non-ASCII bytes.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
SLICE_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD6E8FEB86659FD93


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text, at least one row each."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and ends in them; NULL is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def find_words(
    data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~gap[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    filled = bounds[:-1] < bounds[1:]
    at = bounds[:-1][filled]
    begins[at] = word[at]
    at = bounds[1:][filled] - 1
    ends[at] = word[at]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, np.uint64)


def powers(n: int, base: int = STEP) -> np.ndarray:
    """1, base, base², … modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of it."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1
) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _table(seed)
    if lower:
        table = table[LOWER]
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    letters = data[inside + np.repeat(starts, lengths)]
    total = np.add.reduceat(table[letters] * powers(int(lengths.max()))[inside], at)
    return mix(total + lengths.astype(np.uint64) * BASE)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, and the word each run starts at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for offset, factor in enumerate(powers(width, step)):
        total += hashes[offset : offset + n] * factor
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= row_end)
    return mix(total[at]), at
