"""CRC-32 of any substring of a text from the running CRCs of its prefixes.

The register of a CRC, started from 0, is linear over GF(2): what a prefix leaves in the register is shifted on by the
bytes that follow, and added to what these leave by themselves. So the CRC of bytes i to j comes from the registers at i
and j: the first is shifted by j - i bytes and cancels in the second. A shift by n bytes is a 32 by 32 bit matrix, kept
as four tables of 256 words, one for each byte of the register.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that are run through one after the other; as many runs as a text has such segments go side by side.
SEGMENT = 64
_SHORT = 64


@lru_cache
def _table() -> np.ndarray:
    """The register after one byte, from 0."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1)).astype(np.uint32)
    return x


def _lanes(columns: np.ndarray) -> np.ndarray:
    """Four tables of a matrix whose columns, the images of the 32 bits, are given."""
    byte = np.arange(256)
    out = np.zeros((4, 256), dtype=np.uint32)
    for lane in range(4):
        for bit in range(8):
            out[lane] ^= np.where(byte >> bit & 1, columns[8 * lane + bit], 0).astype(np.uint32)
    return out


def _apply(lanes: np.ndarray, x: np.ndarray) -> np.ndarray:
    return lanes[0][x & 255] ^ lanes[1][x >> 8 & 255] ^ lanes[2][x >> 16 & 255] ^ lanes[3][x >> 24]


@lru_cache
def _doubled(power: int) -> np.ndarray:
    """The shift by 2 ** power bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        return _lanes(_table()[bits & np.uint32(255)] ^ bits >> np.uint32(8))
    half = _doubled(power - 1)
    return _lanes(_apply(half, _apply(half, bits)))


@lru_cache
def _short() -> np.ndarray:
    """The shifts by 0 to 63 bytes, in a row for each lane: the shift's number times 256 plus the byte."""
    columns = [np.uint32(1) << np.arange(32, dtype=np.uint32)]
    for _ in range(_SHORT - 1):
        columns.append(_apply(_doubled(0), columns[-1]))
    return np.ascontiguousarray(np.stack([_lanes(c) for c in columns]).transpose(1, 0, 2)).reshape(4, -1)


def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    lanes, at = _short(), (by & (_SHORT - 1)) << 8
    out = lanes[0][at | x & 255] ^ lanes[1][at | x >> 8 & 255] ^ lanes[2][at | x >> 16 & 255] ^ lanes[3][at | x >> 24]
    more, power = by >> 6, 6
    while more.any():
        some = np.flatnonzero(more & 1)
        out[some] = _apply(_doubled(power), out[some])
        more, power = more >> 1, power + 1
    return out


class PrefixCrc:
    """The running registers of a text, stored for every byte within its segment and for the start of each segment."""

    def __init__(self, data: np.ndarray):
        """data is an array of bytes; it is read once."""
        n = len(data) // SEGMENT + 1
        side = np.zeros(n * SEGMENT, dtype=np.uint8)
        side[: len(data)] = data
        side = np.ascontiguousarray(side.reshape(n, SEGMENT).T)
        table = _table()
        self.inside = np.zeros((SEGMENT + 1, n), dtype=np.uint32)
        for t in range(SEGMENT):
            x = self.inside[t]
            self.inside[t + 1] = table[(x ^ side[t]) & 255] ^ x >> np.uint32(8)
        # A segment starts with all that went before: each gathers twice as many as the step before.
        ends, power = self.inside[SEGMENT].copy(), 6
        while (step := 1 << (power - 6)) < n:
            ends[step:] = ends[step:] ^ _apply(_doubled(power), ends[:-step])
            power += 1
        self.starts = np.concatenate([np.zeros(1, dtype=np.uint32), ends[:-1]])

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The registers after so many bytes."""
        segment, t = positions // SEGMENT, positions % SEGMENT
        return self.inside[t, segment] ^ shifted(self.starts[segment], t)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """CRC-32 of the bytes from each first to before each last."""
        return self.at(last) ^ shifted(self.at(first) ^ ONES, last - first) ^ ONES
