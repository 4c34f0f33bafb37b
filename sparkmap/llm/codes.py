"""Directly addressable codes: any id of a block without decoding the block.

An id is split into chunks of 8 bits, low chunk first.  Level k holds chunk k of
every id that has one, and a bitmap that tells which of them go on in level
k + 1.  The place in the next level is the number of continuation bits before
this one, which a directory of counts at every 512 bits answers in one step.

Layout of a block, little-endian: "DAC1", u32 number of levels, then for each
level u32 n, n chunk bytes, ceil(n / 8) bitmap bytes (lowest bit first) and
ceil(n / 512) u32 counts of the continuation bits before each stretch.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
STRETCH = 512


def pack(ids: np.ndarray) -> bytes:
    rest = np.asarray(ids, np.uint32)
    levels = []
    while len(rest) or not levels:
        goes_on = rest > 255
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), STRETCH)) if len(rest) else np.zeros(0, int)
        directory = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[goes_on] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Block:
    """A packed block, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.levels = []
        at = 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n = struct.unpack_from("<I", data, at)[0]
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 4 + n)
            directory = np.frombuffer(data, "<u4", -(-n // STRETCH), at + 4 + n + len(bits))
            at += 4 + n + len(bits) + 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Continuation bits before place i."""
        if i >= len(bits) * 8 or i // STRETCH >= len(directory):
            return int(np.unpackbits(bits).sum())
        first = i // STRETCH * (STRETCH // 8)
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        return int(directory[i // STRETCH]) + whole + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, directory, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop, from those places of each level only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        parts = []
        for chunks, bits, directory in self.levels:
            on = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            parts.append((chunks[start:stop], on))
            if not on.any():
                break
            start, stop = self._rank(bits, directory, start), self._rank(bits, directory, start) + int(on.sum())
        value = np.zeros(0, np.uint32)
        for chunks, on in reversed(parts):
            out = chunks.astype(np.uint32)
            out[on] |= value << 8
            value = out
        return value
