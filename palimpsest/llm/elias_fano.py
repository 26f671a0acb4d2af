"""Elias-Fano coding of a non-decreasing sequence, with select by samples that are part of the code."""

from __future__ import annotations

import struct

import numpy as np

#: The place of every so many-th set bit is stored, so that select reads a short stretch.
SAMPLE = 256
_HEAD = struct.Struct("<QQBBQ")


def encode(values: np.ndarray) -> bytes:
    """Low bits packed side by side, high bits in unary: about 2 + log2(range / count) bits a value, and an eighth of a
    bit for samples (a quarter where the unary part is longer than 2^32 bits)."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    high = np.zeros((top >> low) + n + 1, np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high[ones] = 1
    width = 4 if len(high) < 1 << 32 else 8
    samples = ones[::SAMPLE].astype(f"<u{width}").tobytes()
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    upper = np.packbits(high, bitorder="little").tobytes()
    return _HEAD.pack(n, top, low, width, len(upper)) + samples + upper + np.packbits(lows, bitorder="little").tobytes()


class Sequence:
    """Reads what encode wrote, in place: opening it builds no table."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.top, self.low, width, size = _HEAD.unpack_from(data)
        at = _HEAD.size
        self._samples = np.frombuffer(data, f"<u{width}", -(-self.n // SAMPLE), at)
        at += self._samples.nbytes
        self._upper = np.frombuffer(data, np.uint8, size, at)
        self._lower = np.frombuffer(data, np.uint8, -1, at + size)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_run(i, 1)[0])

    def select_run(self, i: int, count: int) -> np.ndarray:
        """The i-th value and those after it, count in all: unary bits are read from the sample at or before the i-th
        set bit to the one after the last, so no more than the run and two samples' stretches are in memory."""
        if not (0 <= i and count >= 0 and i + count <= self.n):
            raise IndexError(i)
        if not count:
            return np.empty(0, np.int64)
        first, after = i // SAMPLE, (i + count - 1) // SAMPLE + 1
        begin = int(self._samples[first]) >> 3
        stop = (int(self._samples[after]) >> 3) + 1 if after < len(self._samples) else len(self._upper)
        ones = np.flatnonzero(np.unpackbits(self._upper[begin:stop], bitorder="little")) + begin * 8
        ones = ones[np.searchsorted(ones, int(self._samples[first])) :]  # a byte may hold set bits before the sample
        high = ones[i - first * SAMPLE :][:count] - np.arange(i, i + count)
        if not self.low:
            return high
        a = i * self.low
        bits = np.unpackbits(self._lower[a >> 3 : (a + count * self.low + 7) >> 3], bitorder="little")[a & 7 :][: count * self.low]
        return (high << self.low) | (bits.reshape(count, self.low).astype(np.int64) << np.arange(self.low)).sum(1)

    def size(self) -> int:
        return _HEAD.size + self._samples.nbytes + len(self._upper) + (self.n * self.low + 7) // 8
