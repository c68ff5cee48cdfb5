"""Monotone sequences in near-minimal space, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many values the place of its bit is kept, so that select scans a bounded stretch.
SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")


class EliasFano:
    """Ascending values below ``2**63``: low bits packed, high parts as a bit vector in unary.

    With n values up to u this takes about ``2 + log2(u / n)`` bits for each value,
    and 32 bits for every ``SAMPLE`` values so that ``select`` needs no table of offsets.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        places = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def values(self) -> np.ndarray:
        """All values, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = bits @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)) if self.low_bits else np.zeros(self.n, np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def select(self, i: int) -> int:
        """Value number ``i``: a sampled place, then at most ``SAMPLE`` ones further."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, byte = i % SAMPLE, int(self.samples[i // SAMPLE]) // 8
        skipped = int(self.samples[i // SAMPLE]) % 8
        wanted = place + int(np.bitwise_count(self.high[byte] & np.uint8((1 << skipped) - 1)))
        while True:
            counts = np.cumsum(np.bitwise_count(self.high[byte : byte + SAMPLE]).astype(np.int64))
            if counts[-1] > wanted:
                break
            wanted, byte = wanted - int(counts[-1]), byte + SAMPLE
        at = int(np.searchsorted(counts, wanted, "right"))
        rest = wanted - (int(counts[at - 1]) if at else 0)
        one = (byte + at) * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte + at : byte + at + 1], bitorder="little"))[rest])
        start = i * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : (start + self.low_bits + 7) // 8], bitorder="little")[start % 8 :][: self.low_bits]
        return ((one - i) << self.low_bits) | sum(int(b) << k for k, b in enumerate(bits))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, len(self.samples), self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, start: int = 0) -> tuple[EliasFano, int]:
        """The sequence at ``start`` and where it ends."""
        n, samples, low_bits, low, high = _HEAD.unpack_from(data, start)
        start += _HEAD.size
        parts = []
        for kind, size in (("<u4", 4 * samples), (np.uint8, low), (np.uint8, high)):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, start))
            start += size
        return cls(n, low_bits, parts[1], parts[2], parts[0]), start
