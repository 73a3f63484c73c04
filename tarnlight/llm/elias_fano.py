"""Elias-Fano coding of non-decreasing integers, with select.

A value's low bits are packed as they are; its high bits are unary in a bit
vector of at most two bits a value more. A directory, stored with them, holds one
32-bit count per 512 bits of that vector, so ``select`` looks at one such block a
value and needs no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<QBQQQ")
_BLOCK_BITS = 512
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)
#: Place of the k-th one of a byte.
_PLACE = np.array([[*(b for b in range(8) if x >> b & 1), *[0] * 8][:8] for x in range(256)], np.uint8)


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    directory: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned, non-decreasing."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        picked = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(picked.astype(np.uint8).ravel(), bitorder="little")
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1 if n else 0) // _BLOCK_BITS) * _BLOCK_BITS, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low, high, cls._counts(high))

    @staticmethod
    def _counts(high: np.ndarray) -> np.ndarray:
        ones = _ONES[high].reshape(-1, _BLOCK_BITS // 8).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= (self.low[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(np.uint64) << np.uint64(b)
        return out

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: the places of the i-th ones in the high vector, less i, with the low bits below them."""
        i = np.asarray(i, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("no such value")
        block = np.searchsorted(self.directory, i, "right") - 1
        own = self.high.reshape(-1, _BLOCK_BITS // 8)[block]
        upto = np.cumsum(_ONES[own], axis=1, dtype=np.int64)
        rest = i - self.directory[block].astype(np.int64)
        byte = (upto <= rest[:, None]).sum(1)
        every = np.arange(len(i))
        rest -= np.where(byte > 0, upto[every, np.maximum(byte - 1, 0)], 0)
        place = block * _BLOCK_BITS + byte * 8 + _PLACE[own[every, byte], rest]
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low_at(i)

    def select(self, i: int) -> int:
        return int(self.select_many(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values, as uint64."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        out = (place - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, -1)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.directory))
        return head + self.directory.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at byte ``at``, and where it ends."""
        n, low_bits, n_low, n_high, n_counts = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        directory = np.frombuffer(data, "<u4", n_counts, at)
        at += 4 * n_counts
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, directory), at + n_low + n_high
