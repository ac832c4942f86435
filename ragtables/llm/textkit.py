"""Vectorised work on the UTF-8 bytes of Arrow string columns, shared by the operators.

Tasks receive Arrow batches and look at the texts as one byte buffer with
offsets, so splitting into words and fingerprinting them costs a few numpy
passes over the bytes and makes no Python object per word. A word is a
maximal run of bytes other than the six ASCII white-space characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LONG = 256  # bytes beyond which a span is fingerprinted by itself
BATCH_BYTES = 8 << 20  # texts handled together
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches, column: str, most: int = BATCH_BYTES):
    """Record batches cut so that the texts (or lists) of each hold at most `most` bytes (or entries), or one text."""
    for batch in batches:
        length = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
        sizes = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield batch.slice(at)


#: Everything but letters, digits and the bytes of characters beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The byte spans as strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of its values."""
    return np.bincount(rows, values, n) if len(rows) else np.zeros(n)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the intercept last (not shrunk)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of the byte spans [start, end). Equal bytes, equal fingerprint, wherever they stand.

    Eight bytes at a time are mixed into what came before, so no sum of powers is there to cancel out; spans of more than
    LONG bytes, of which there are few, go through BLAKE2 one by one. Fingerprints of different seeds are independent.
    """
    if lower:
        data = _LOWER[data]
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + _SEEDS[seed])
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(out ^ (eight[starts] & _KEEP[np.minimum(size, 8)]))
    at, live = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] ^ (eight[starts[live] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


class Words:
    """Words of a batch of texts: byte spans, and for text d the words ptr[d]..ptr[d+1].

    apart: which of the 256 byte values part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        if len(data):
            inside = ~apart[data]
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True  # a text begins here
            before = np.concatenate([[False], inside[:-1]])
            self.starts = np.flatnonzero(inside & (first[:-1] | ~before))
            after = np.concatenate([inside[1:], [False]])
            self.ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.ptr = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.ptr)

    def hashes(self, *, lower: bool = False, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower=lower, seed=seed)

    def docs(self) -> np.ndarray:
        """For each word, the text it is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of every run of `size` successive hashes (also across texts: the caller masks)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15 if seed == 0 else 0xC2B2AE3D27D4EB4F)
    for k in range(size):
        out ^= out >> np.uint64(29)  # so that the whole is no polynomial in the step
        out *= step
        out += hashes[k : k + n]
    return mix(out)


def full_windows(ptr: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of `size` words that lie in one text."""
    counts = np.maximum(np.diff(ptr) - size + 1, 0)
    return ragged(ptr[:-1], counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... (count of them) for each row, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of appearance, where each appears first, and which one each entry is; by hashing, not by a sort."""
    code, own = pd.factorize(keys)
    first = np.empty(len(own), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]  # the last one written stays: the first of its key
    return own, first, code


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(column, kind) -> np.ndarray:
    """All values packed in a binary column, one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def spread(spark, factor: int = 4) -> int:
    """Number of buckets for grouped work: follows spark.sql.shuffle.partitions, which is sized to the input."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))
