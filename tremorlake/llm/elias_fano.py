"""Elias-Fano coding of non-decreasing whole numbers, with select."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 512  # bits of the upper part between two entries of the rank directory


class EliasFano(NamedTuple):
    """``low`` holds the lower ``width`` bits of each number in a row; ``high`` has bit (x >> width) + i set for number i;
    ``ranks`` counts the set bits in front of each block of ``high`` (4 bytes for 512 bits)."""

    count: int
    width: int
    low: bytes
    high: bytes
    ranks: bytes

    @staticmethod
    def of(numbers: np.ndarray) -> EliasFano:
        """About 2 + log2(largest / count) bits a number. The numbers must not be negative or fall."""
        x = np.asarray(numbers, np.uint64)
        n = len(x)
        largest = int(x[-1]) if n else 0
        width = max(0, (largest // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // BLOCK + 1) * BLOCK if n else 0, np.uint8)
        bits[at] = 1
        ones = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        return EliasFano(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), ranks.tobytes())

    def select(self, which: np.ndarray, run: int = 8192) -> np.ndarray:
        """The numbers at the given places, by the rank directory and one block of the upper part each."""
        which = np.asarray(which, np.int64)
        ranks = np.frombuffer(self.ranks, "<u4").astype(np.int64)
        blocks = np.frombuffer(self.high, np.uint8).reshape(-1, BLOCK // 8)
        low = np.frombuffer(self.low, np.uint8)
        out = np.empty(len(which), np.uint64)
        for start in range(0, len(which), run):
            i = which[start:start + run]
            block = np.searchsorted(ranks, i, "right") - 1
            ones = np.cumsum(np.unpackbits(blocks[block], axis=1, bitorder="little"), axis=1, dtype=np.int32)
            inside = np.argmax(ones > (i - ranks[block])[:, None], axis=1)
            value = (block * BLOCK + inside - i).astype(np.uint64) << np.uint64(self.width)
            for b in range(self.width):
                at = i * self.width + b
                value |= ((low[at >> 3] >> (at & 7)) & 1).astype(np.uint64) << np.uint64(b)
            out[start:start + run] = value
        return out
