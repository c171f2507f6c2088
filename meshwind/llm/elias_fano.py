"""Elias-Fano coding of ascending numbers: low bits packed, high bits in unary, and a directory for select."""

from __future__ import annotations

import struct

import numpy as np

#: Bits of the unary part between two entries of the select directory.
BLOCK_BITS = 512
_HEAD = struct.Struct("<QQB7x")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending sequence of whole numbers below 2**63: about 2 + log2(largest / count) bits a number."""
    values = np.asarray(values, np.int64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = np.zeros((n, width), np.uint8)
    for bit in range(width):
        low[:, bit] = values >> bit & 1
    unary = np.zeros(-(-(n + (top >> width) + 1) // BLOCK_BITS) * BLOCK_BITS, np.uint8)
    unary[(values >> width) + np.arange(n)] = 1
    directory = np.cumsum(unary.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
    parts = np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), directory.astype("<u4").tobytes()
    return _HEAD.pack(n, len(parts[1]), width) + b"".join(parts)


class EliasFano:
    """Reads ``encode``'s bytes: ``select`` gives the numbers at any places without decoding the rest."""

    def __init__(self, data: bytes):
        self.n, size, self.width = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = -(-self.n * self.width // 8)
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, size, at + low)
        self.directory = np.frombuffer(data, "<u4", size * 8 // BLOCK_BITS, at + low + size).astype(np.int64)

    def __len__(self) -> int:
        return self.n

    def select(self, places) -> np.ndarray:
        """The numbers at ``places``: the directory finds each one's block, byte counts its byte, its bits the bit."""
        places = np.asarray(places, np.int64)
        block = np.searchsorted(self.directory, places, side="right")
        rank = places - np.where(block > 0, self.directory[block - 1], 0)
        held = self.high.reshape(-1, BLOCK_BITS // 8)[block]
        ones = np.cumsum(_ONES[held], axis=1, dtype=np.int64)
        byte = (ones <= rank[:, None]).sum(axis=1)
        row = np.arange(len(places))
        rank -= np.where(byte > 0, ones[row, byte - 1], 0)
        bits = np.cumsum(np.unpackbits(held[row, byte][:, None], axis=1, bitorder="little"), axis=1)
        where = block * BLOCK_BITS + byte * 8 + (bits <= rank[:, None]).sum(axis=1)
        out = where - places << self.width
        for bit in range(self.width):
            at = places * self.width + bit
            out |= (self.low[at >> 3].astype(np.int64) >> (at & 7) & 1) << bit
        return out
