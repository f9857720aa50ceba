"""Elias-Fano coding of non-decreasing numbers.

``n`` numbers up to ``u`` take about ``2 + log2(u / n)`` bits each: their low bits side by
side, their high bits as gaps in a bitmap. The place of every 256th set bit is kept,
so that one number is found without reading the others.
"""

from __future__ import annotations

import struct

import numpy as np

STRIDE = 256
HEAD = struct.Struct("<QQBxxxxxxx")
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """The coded form of non-negative, non-decreasing numbers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return HEAD.pack(0, 0, 0)
    if np.any(values[1:] < values[:-1]):
        raise ValueError("Elias-Fano needs numbers in order.")
    top = int(values[-1])
    low = max(0, (max(top, 1) // n).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(places[-1]) // 8 + 1, np.uint8)
    np.bitwise_or.at(upper, places >> 3, (1 << (places & 7)).astype(np.uint8))
    samples = places[::STRIDE].astype("<u8")
    return HEAD.pack(n, len(upper), low) + lower.tobytes() + upper.tobytes() + samples.tobytes()


class Sequence:
    """Reads coded numbers: one by :meth:`select`, or all by :meth:`values`."""

    def __init__(self, data: bytes):
        self.n, size, self.low = HEAD.unpack_from(data)
        at = HEAD.size
        lower = (self.n * self.low + 7) // 8
        self.lower = np.frombuffer(data, np.uint8, lower, at)
        self.upper = np.frombuffer(data, np.uint8, size, at + lower)
        self.samples = np.frombuffer(data, "<u8", -(-self.n // STRIDE), at + lower + size)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first = i * self.low
        chunk = self.lower[first >> 3 : (first + self.low + 7) >> 3].tobytes()
        return (int.from_bytes(chunk, "little") >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The ``i``-th number: from the nearest sample on, whole bytes are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // STRIDE])
        missing = i % STRIDE
        byte, bit = place >> 3, place & 7
        current = int(self.upper[byte]) >> bit << bit
        while (found := int(POPCOUNT[current])) <= missing:
            missing -= found
            byte += 1
            current = int(self.upper[byte])
        for _ in range(missing):
            current &= current - 1
        place = byte * 8 + (current & -current).bit_length() - 1
        return ((place - i) << self.low) | self._low(i)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
