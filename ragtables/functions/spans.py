"""Words and substrings found in the UTF-8 bytes of Arrow string columns, a few numpy passes at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
#: Masks that keep the first n of eight bytes.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def eights(data: np.ndarray) -> np.ndarray:
    """At every place the eight bytes from there on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each row, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter, digit or underscore. Characters beyond ASCII are looked up once each."""
    inside, lead = _WORD[data], np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b, c, d = (padded[lead + k].astype(np.uint32) for k in range(4))
        b, c, d = b & 63, c & 63, d & 63
        width = 2 + (a >= 0xE0).astype(int) + (a >= 0xF0)
        point = np.where(width == 2, (a & 31) << 6 | b, np.where(width == 3, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        kinds, which = np.unique(point, return_inverse=True)
        other = ~np.array([unicodedata.category(chr(p))[0] in "LN" for p in kinds.tolist()])[which]
        for k in range(4):
            inside[lead[other & (width > k)] + k] = False
    return inside


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of letters, digits and underscores inside a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = letters(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans, eight bytes mixed in at a time."""
    eight, size = eights(data), ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    at, live = 0, np.arange(len(size))
    while len(live):
        out[live] = mixed(out[live] ^ (eight[starts[live] + at] & KEEP[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    return out
