"""Elias-Fano code of a non-decreasing sequence: about two bits and the low bits per value, with direct access.

A value is cut into ``low`` bits, kept packed, and a high part, kept as a one in a bit string at position high + index. The
position of every 512th one is kept too, so ``select`` reads a bounded stretch of the string.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 512
HEAD = "<QQB7x"


class EliasFano:
    """A coded sequence of ``n`` values up to ``top``."""

    def __init__(self, n: int, top: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.lows, self.highs, self.samples = n, top, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        lows = np.zeros(0, np.uint8)
        if low and n:
            bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            lows = np.packbits(bits.ravel(), bitorder="little")
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        string = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        string[at] = 1
        return cls(n, top, low, lows, np.packbits(string, bitorder="little"), at[::EVERY].astype(np.uint64))

    def to_bytes(self) -> bytes:
        """Head, samples, high bit string, low bits."""
        parts = [struct.pack(HEAD, self.n, self.top, self.low), self.samples.astype("<u8").tobytes(), self.highs.tobytes(), self.lows.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low = struct.unpack_from(HEAD, data)
        at = struct.calcsize(HEAD)
        samples = np.frombuffer(data, "<u8", -(-n // EVERY), at)
        at += samples.nbytes
        size = -(-((top >> low) + n) // 8) if n else 0
        highs = np.frombuffer(data, np.uint8, size, at)
        lows = np.frombuffer(data, np.uint8, -(-n * low // 8), at + size)
        return cls(n, top, low, lows, highs, samples)

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low, last * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low)
        return bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def select(self, index: int) -> int:
        """The value at ``index``, read from one stretch between two samples."""
        if not 0 <= index < self.n:
            raise IndexError(index)
        block = index // EVERY
        start = int(self.samples[block])
        stop = int(self.samples[block + 1]) + 1 if block + 1 < len(self.samples) else 8 * len(self.highs)
        ones = np.unpackbits(self.highs[start // 8 : -(-stop // 8)], bitorder="little").nonzero()[0] + start // 8 * 8
        at = int(ones[ones >= start][index - block * EVERY])
        return ((at - index) << self.low) | int(self._lows(index, index + 1)[0])

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.unpackbits(self.highs, bitorder="little").nonzero()[0][: self.n]
        return ((ones - np.arange(self.n)) << self.low) | self._lows(0, self.n)
