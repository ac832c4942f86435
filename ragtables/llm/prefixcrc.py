"""CRC-32 of any substring from two running CRCs, by cancelling shifts over GF(2).

The register after a prefix is linear in its bytes, so with R(i) the register behind i bytes (begun at zero) the bytes
from a to b alone would leave R(b) + shift(R(a), b - a), where shift feeds zero bytes and + is exclusive or. One scan
gives R everywhere; every substring then costs one shift. Scan and shifts run on whole arrays: the bytes lie in lanes
that step together, the lanes' starts come from a doubling scan, and a shift by n bytes is a product of the operators
for the powers of two in n.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
LANES = 8192
_ALL = np.uint32(0xFFFFFFFF)
_LOW, _8, _16, _24 = np.uint32(255), np.uint32(8), np.uint32(16), np.uint32(24)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


_BYTE = _byte_table()


def _apply(operator: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of registers, held as four tables of the images of each byte."""
    return operator[0][x & _LOW] ^ operator[1][(x >> _8) & _LOW] ^ operator[2][(x >> _16) & _LOW] ^ operator[3][x >> _24]


def _powers(most: int = 48) -> list[np.ndarray]:
    """Operators that feed 1, 2, 4, 8... zero bytes."""
    images = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    out = [np.stack([_BYTE[x & _LOW] ^ (x >> _8) for x in images])]
    while len(out) < most:
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return out


_POWERS = _powers()


def shifted(registers: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Each register after n zero bytes."""
    out = registers.copy()
    if isinstance(n, int):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _apply(_POWERS[k], out)
        return out
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        out[at] = _apply(_POWERS[k], out[at])
    return out


class RunningCrc:
    """The registers behind every prefix of the bytes."""

    def __init__(self, data: np.ndarray):
        lanes = max(1, min(LANES, len(data) // 64))
        self.width = len(data) // lanes + 1
        padded = np.zeros(lanes * self.width, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, self.width).T)
        state = np.zeros(lanes, np.uint32)
        self.inside = np.empty((self.width, lanes), np.uint32)  # before each byte, as if its lane began at zero
        for i, column in enumerate(columns):
            self.inside[i] = state
            state = _BYTE[(state ^ column) & _LOW] ^ (state >> _8)
        reach = 1
        while reach < lanes:  # state[k] covers the lanes from k - 2 * reach + 1 on
            state[reach:] ^= shifted(state[:-reach], reach * self.width)
            reach *= 2
        self.before = np.concatenate([np.zeros(1, np.uint32), state[:-1]])

    def at(self, positions: np.ndarray) -> np.ndarray:
        lane, off = np.divmod(positions, self.width)
        return self.inside[off, lane] ^ shifted(self.before[lane], off)


def behind(registers: np.ndarray, byte: int) -> np.ndarray:
    """The registers after one byte more."""
    return _BYTE[(registers ^ np.uint32(byte)) & _LOW] ^ (registers >> _8)


def between(start: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes between two prefixes, from their registers and the distance."""
    return end ^ shifted(start ^ _ALL, length) ^ _ALL
