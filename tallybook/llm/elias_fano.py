"""Ascending numbers in near-minimal space (Elias-Fano), with a select structure.

Of n numbers below u, each keeps its lowest ``floor(log2(u / n))`` bits as they are; what is above
them is written in unary, as one bitmap of n ones and at most 2 n zeros. Number ``i`` is read back as
the place of the i-th one, less i, with the low bits behind it. The places of every ``STEP``-th one
are kept as 32-bit numbers; from there a few words of the bitmap are counted. In all some
``2 + log2(u / n)`` bits a number.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QQBQQQ")
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Numbers packed at a time.
_BLOCK = 1 << 16


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, lowest bit first; 16 spare bytes."""
    parts = []
    for at in range(0, len(values), _BLOCK):  # a block of 2**16 values fills whole bytes
        block = values[at : at + _BLOCK]
        bits = (block[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(16, dtype=np.uint8)])


class EliasFano:
    """``n`` ascending numbers from 0; equal ones are allowed."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self._low, self._high, self._samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must ascend")
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        above = (values >> np.uint64(width)).astype(np.int64)
        ones = above + np.arange(n)
        size = int(ones[-1]) + 1 if n else 0
        if size >= 1 << 32:
            raise ValueError("too many numbers for 32-bit samples: use more, smaller files")
        bitmap = np.zeros(-(-size // 64) * 8, dtype=np.uint8)
        np.bitwise_or.at(bitmap, ones >> 3, (np.uint8(1) << (ones & 7).astype(np.uint8)))
        return cls(n, width, _pack(values, width), bitmap, ones[::STEP].astype("<u4"))

    def tobytes(self) -> bytes:
        head = _HEAD.pack(self.n, len(self._low), self.width, len(self._high), len(self._samples), 0)
        return head + self._low.tobytes() + self._high.tobytes() + self._samples.tobytes()

    @classmethod
    def frombytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The numbers stored at ``at``, and where they end."""
        n, low_size, width, high_size, samples, _ = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low = np.frombuffer(data, np.uint8, low_size, at)
        high = np.frombuffer(data, np.uint8, high_size, at + low_size)
        picked = np.frombuffer(data, "<u4", samples, at + low_size + high_size)
        return cls(n, width, low, high, picked), at + low_size + high_size + 4 * samples

    def _place(self, i: int) -> int:
        """Where the i-th one of the bitmap is: from the sample before it on, bytes are counted."""
        place = int(self._samples[i // STEP])
        left = i % STEP
        byte = place >> 3
        found = int(self._high[byte]) >> (place & 7) << (place & 7)  # the ones from the sample on
        while True:
            chunk = self._high[byte : byte + 64]
            counts = np.cumsum(_POPCOUNT[np.concatenate([np.array([found], dtype=np.uint8), chunk[1:]])])
            if left < counts[-1]:
                k = int(np.searchsorted(counts, left, side="right"))
                before = int(counts[k - 1]) if k else 0
                value = found if k == 0 else int(chunk[k])
                bits = np.flatnonzero(np.unpackbits(np.array([value], dtype=np.uint8), bitorder="little"))
                return (byte + k) * 8 + int(bits[left - before])
            left -= int(counts[-1])
            byte += len(chunk)
            found = int(self._high[byte])

    def _low_bits(self, which: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(which), dtype=np.uint64)
        at = which.astype(np.int64) * self.width
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        out = np.zeros(len(which), dtype=np.uint64)
        for k in range(8):
            out |= self._low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        out >>= shift
        ninth = self._low[byte + 8].astype(np.uint64)
        out |= np.where(shift > 0, ninth << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.width) - 1)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Number ``i``, by select on the bitmap."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self._place(i) - i) << self.width) | int(self._low_bits(np.array([i]))[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Numbers ``start`` to ``end``, the latter left out, as an array of unsigned 64-bit numbers."""
        end = min(end, self.n)
        if start >= end:
            return np.empty(0, dtype=np.uint64)
        first, last = self._place(start), self._place(end - 1)
        bits = np.unpackbits(self._high[first >> 3 : (last >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[: end - start] + first
        which = np.arange(start, end)
        return ((ones - which).astype(np.uint64) << np.uint64(self.width)) | self._low_bits(which)
