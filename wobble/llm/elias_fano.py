"""Elias-Fano coding of a non-decreasing sequence, with a select structure.

A value below ``u`` of a sequence of ``n`` is split into ``l = floor(log2(u / n))`` low bits, packed end to end,
and a high part kept in unary: bit ``high + i`` is set for the ``i``-th value. That takes about ``2 + l`` bits a
value. Every ``STEP``-th set bit's place is sampled in 32 bits (a sequence with more high bits is refused), so that
``select(i)`` reads a sample and then a few bytes, and ``window(a, b)`` decodes no more than it returns.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, STEP = b"WEF1", 512
#: Values that are coded at a time.
BLOCK = 1 << 13
HEAD = struct.Struct("<4sQQqB3xQQ")
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class EliasFano:
    """An encoded sequence: ``low`` and ``high`` are bytes (bits from the least significant one on)."""

    def __init__(self, n: int, base: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.bits, self.low, self.high, self.samples = n, base, bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, np.int64)
        if len(x) and (np.diff(x) < 0).any():
            raise ValueError("the sequence must not decrease")
        n, base = len(x), int(x[0]) if len(x) else 0
        x = (x - base).astype(np.uint64)
        span = int(x[-1]) + 1 if n else 1
        bits = max(0, (span // max(n, 1)).bit_length() - 1)
        at = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        if n and at[-1] >= (1 << 32) - 1:
            raise ValueError("one coded sequence has fewer than 2**32 high bits; write more shards")
        # each set bit is one value's, so sums of bits are their union
        high = np.zeros((int(at[-1]) >> 3) + 1 if n else 0, np.uint8)
        np.add.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        low = [np.zeros(0, np.uint8)]
        for i in range(0, n, BLOCK):  # a block's bits fill whole bytes
            cells = ((x[i : i + BLOCK, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low.append(np.packbits(cells.ravel(), bitorder="little"))
        return cls(n, base, bits, np.concatenate(low), high, at[::STEP].astype(np.uint32))

    def tobytes(self) -> bytes:
        head = HEAD.pack(MAGIC, self.n, STEP, self.base, self.bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        magic, n, step, base, bits, n_low, n_high = HEAD.unpack_from(data)
        if magic != MAGIC or step != STEP:
            raise ValueError("not an Elias-Fano file of this format")
        raw = np.frombuffer(data, np.uint8, offset=HEAD.size)
        return cls(n, base, bits, raw[:n_low], raw[n_low : n_low + n_high], raw[n_low + n_high :].view("<u4"))

    def place(self, i: int) -> int:
        """The place of the ``i``-th set bit of the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STEP]), i % STEP
        byte = at >> 3
        # `left` more set bits after place `at`
        left += int(ONES[self.high[byte] & ((1 << (at & 7)) - 1)])
        while True:
            seen = np.cumsum(ONES[self.high[byte : byte + 128]])
            k = int(np.searchsorted(seen, left, "right"))
            if k < len(seen):
                break
            left -= int(seen[-1])
            byte += 128
        left -= int(seen[k - 1]) if k else 0
        byte += k
        return byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])

    def select(self, i: int) -> int:
        """The ``i``-th value, from 0."""
        return self.base + (((self.place(i) - i) << self.bits) | self._low(i))

    def upto(self, value: int, first: int = 0) -> int:
        """How many values are ``value`` or less, if the first ``first`` are; by selects."""
        a, b = first, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.select(mid) <= value else (a, mid)
        return a

    def window(self, a: int, b: int) -> np.ndarray:
        """The values ``a`` to ``b - 1``, from the bytes that hold them."""
        if a >= b:
            return np.zeros(0, np.int64)
        start, end = self.place(a), self.place(b - 1)
        bits = np.unpackbits(self.high[start >> 3 : (end >> 3) + 1], bitorder="little")
        at = np.flatnonzero(bits[start & 7 :])[: b - a] + start
        out = (at - np.arange(a, b)) << self.bits
        if self.bits:
            first = a * self.bits
            cells = np.unpackbits(self.low[first >> 3 : (b * self.bits + 7) >> 3], bitorder="little")[first & 7 :][: (b - a) * self.bits]
            out |= cells.reshape(b - a, self.bits).astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        return out + self.base

    def _low(self, i: int) -> int:
        first, last = i * self.bits, (i + 1) * self.bits
        part = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (part >> (first & 7)) & ((1 << self.bits) - 1)
