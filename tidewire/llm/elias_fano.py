"""Rising sequences in Elias-Fano form, searched many values at a time.

A value's low bits are stored as they are, its high bits in unary: a one for each value, a zero after each
value of the high bits. That takes about two bits a value more than the low bits.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, one after the other, in 64-bit numbers."""
    at = np.arange(len(values), dtype=np.int64) * width
    out = np.zeros((len(values) * width + 63) // 64 + 1, U64)
    if width and len(values):
        word, bit = at >> 6, (at & 63).astype(U64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << bit, first)
        over = np.flatnonzero(bit.astype(np.int64) + width > 64)  # one at most for each word
        out[word[over] + 1] |= values[over] >> (U64(64) - bit[over])
    return out


class EliasFano:
    """A non-decreasing sequence of numbers below ``universe``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low, self.high = n, width, low, high
        bits = np.unpackbits(high, bitorder="little")
        self.ones = np.flatnonzero(bits)
        zeros = np.flatnonzero(bits == 0)
        # Where the values with each value of the high bits begin.
        self.begins = np.concatenate([[0], zeros - np.arange(len(zeros))])

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Number of values, width of the low bits, low bits, and high bits."""
        n = len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(U64)
        places = (values >> U64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (universe >> width) + 2, np.uint8)
        bits[places] = 1
        return n, width, _packed(values & U64((1 << width) - 1), width), np.packbits(bits, bitorder="little")

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U64)
        start = at.astype(np.int64) * self.width
        word, bit = start >> 6, (start & 63).astype(U64)
        value = self.low[word] >> bit
        over = bit.astype(np.int64) + self.width > 64
        value[over] |= self.low[word[over] + 1] << (U64(64) - bit[over])
        return value & U64((1 << self.width) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        return ((self.ones[at] - at).astype(U64) << U64(self.width)) | self._low(at)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each value's first successor if that is the value itself, else -1.

        With ``first`` and ``last``, only places from the one to before the other are looked at.
        """
        values = values.astype(U64)
        high = (values >> U64(self.width)).astype(np.int64)
        inside = high < len(self.begins) - 1
        high = np.where(inside, high, 0)
        at, end = self.begins[high], np.where(inside, self.begins[high + 1], 0)
        if first is not None:
            at, end = np.maximum(at, first), np.minimum(end, last)
        goal = values & U64((1 << self.width) - 1)
        stop = end.copy()
        left = np.flatnonzero(at < end)
        while len(left):
            middle = (at[left] + end[left]) >> 1
            less = self._low(middle) < goal[left]
            at[left[less]] = middle[less] + 1
            end[left[~less]] = middle[~less]
            left = left[at[left] < end[left]]
        there = np.flatnonzero(at < stop)
        out = np.full(len(values), -1, np.int64)
        same = there[self._low(at[there]) == goal[there]]
        out[same] = at[same]
        return out
