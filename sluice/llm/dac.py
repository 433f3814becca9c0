"""Directly addressable codes for token ids (no Spark here).

Ids are split into 8-bit chunks. Level 0 has the low chunk of every id, level
k + 1 the next chunk of those ids that have more; a bitmap beside each level
says which go on, and a rank directory (ones before every 512th bit) says
where in the next level they do. So the id at any place is found by one rank
for each of its chunks, without decoding what stands before it.

Layout of a segment, little-endian: b"DAC1", uint32 levels, uint64 ids; for
each level uint64 chunks, the chunks, and but for the last the bitmap (padded
to 64 bytes) and the uint32 directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
_BLOCK = 512  # bits between entries of a rank directory


def encode(ids: np.ndarray) -> bytes:
    """The segment of the ids (below 2^32)."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels = max(1, -(-int(rest.max(initial=0)).bit_length() // 8))
    out = [MAGIC, struct.pack("<IQ", levels, len(rest))]
    for level in range(levels):
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        if level < levels - 1:
            more = rest > 0xFF
            bits = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, np.bool_)
            bits[: len(rest)] = more
            ones = bits.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint32)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()]
            rest = rest[more] >> 8
    return b"".join(out)


class Segment:
    """Random access to the ids of an encoded segment."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", data, 4)
        at, self.chunks, self.bitmaps, self.ranks = 16, [], [], []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            self.chunks.append(np.frombuffer(data, np.uint8, n, at + 8))
            at += 8 + n
            if level < levels - 1:
                blocks = -(-n // _BLOCK)
                self.bitmaps.append(np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, at))
                at += blocks * _BLOCK // 8
                self.ranks.append(np.frombuffer(data, np.uint32, blocks, at))
                at += 4 * blocks

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a level's bitmap."""
        block = i // _BLOCK
        if block >= len(self.ranks[level]):
            return len(self.chunks[level + 1])
        part = self.bitmaps[level][block * _BLOCK // 8 : i // 8]
        ones = int(np.bitwise_count(part).sum(dtype=np.int64))
        if i % 8:
            ones += (int(self.bitmaps[level][i // 8]) & ((1 << i % 8) - 1)).bit_count()
        return int(self.ranks[level][block]) + ones

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            value |= int(self.chunks[level][i]) << shift
            if level == len(self.bitmaps) or not int(self.bitmaps[level][i // 8]) >> i % 8 & 1:
                return value
            i = self._rank(level, i)
            level, shift = level + 1, shift + 8

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids at places begin to end - 1; no other chunks are touched."""
        out = self.chunks[0][begin:end].astype(np.uint32)
        where, level = None, 0
        while level < len(self.bitmaps) and end > begin:
            low = begin // 8
            more = np.unpackbits(self.bitmaps[level][low : -(-end // 8)], bitorder="little")[begin - 8 * low : end - 8 * low].view(np.bool_)
            at = np.flatnonzero(more)
            begin = self._rank(level, begin)
            end = begin + len(at)
            where = at if where is None else where[at]
            level += 1
            out[where] |= self.chunks[level][begin:end].astype(np.uint32) << np.uint32(8 * level)
        return out
