"""Elias-Fano sequences: non-decreasing integers in about 2 + log2(universe / n) bits each."""

from __future__ import annotations

import struct

import numpy as np

#: One position is kept for every so many set bits of the upper half.
SAMPLE = 256

HEAD = "<QQBIII"


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing integers from 0. Low bits are packed; the rest is a unary bit vector."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    upper = np.zeros((top >> low) + n + 1, dtype=np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper[ones] = 1
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    raised = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, top, low, len(lower), len(raised), len(samples)) + lower + raised + samples


class EliasFano:
    """Reads a sequence in place: select(i) looks at one sample and the bytes after it."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.top, self.low, a, b, c = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        self.lower = np.frombuffer(data, np.uint8, a, at)
        self.upper = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        self.end = at + a + b + c

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, at = i % SAMPLE, int(self.samples[i // SAMPLE])
        byte, skip = at >> 3, at & 7
        word = int(self.upper[byte]) >> skip << skip
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i << self.low) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        a = i * self.low
        span = self.lower[a >> 3 : (a + self.low + 7) >> 3].tobytes()
        return int.from_bytes(span, "little") >> (a & 7) & ((1 << self.low) - 1)

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: their bits only, found from the samples around them."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        k, after = i // SAMPLE, -(-j // SAMPLE)
        begin = int(self.samples[k]) >> 3
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[begin:end], bitorder="little")) + begin * 8
        first = int(np.searchsorted(ones, int(self.samples[k]))) + i - k * SAMPLE
        high = (ones[first : first + j - i] - np.arange(i, j)) << self.low
        if not self.low:
            return high
        a, b = i * self.low, j * self.low
        bits = np.unpackbits(self.lower[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
        return high | (bits.reshape(j - i, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high.astype(np.int64)
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)
