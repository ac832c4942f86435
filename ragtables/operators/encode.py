"""Texts as vectors. An encoder sees the text itself; the default one hashes words and needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bytes_of, span_prints, word_spans

#: Takes an Arrow array of texts, gives a matrix with a row for each.
Encode = Callable[[pa.Array], np.ndarray]
MOST_BYTES = 4 << 20  # of texts that are encoded together
CACHED = 1 << 18  # words whose places a worker remembers


def hash_encoder(dim: int = 64) -> Encode:
    """Signed counts of hashed words: runs of letters, digits and underscores, in lower case."""
    known: dict[bytes, int] = {}

    def place(word: bytes) -> int:
        """Twice the dimension, plus one if it counts down."""
        at = known.get(word)
        if at is None:
            digest = hashlib.md5(word).hexdigest()
            at = 2 * (int(digest[:8], 16) % dim) + int(digest[8], 16) % 2
            if len(known) < CACHED:
                known[word] = at
        return at

    def encode(texts: pa.Array) -> np.ndarray:
        data, offsets = bytes_of(pc.utf8_lower(texts))
        starts, ends, row = word_spans(data, offsets)
        if not len(starts):
            return np.zeros((len(texts), dim))
        _, first, code = np.unique(span_prints(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = np.array([place(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[code]
        return np.bincount(row * dim + at // 2, 1.0 - 2.0 * (at % 2), len(texts) * dim).reshape(len(texts), dim)

    return encode


def by_length(texts: pa.Array, rows: int | None) -> Iterator[np.ndarray]:
    """Row numbers of the texts in portions: of `rows` texts of like length, or else in order; of MOST_BYTES or one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(size, kind="stable") if rows else np.arange(len(size))
    begin, held = 0, 0
    for i, n in enumerate(size[order].tolist()):
        if i > begin and (held + n > MOST_BYTES or (rows and i - begin == rows)):
            yield order[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(order):
        yield order[begin:]


def embed(df: DataFrame, text_col: str = "text", encoder: Callable[[int], Encode] | None = None, *, dim: int = 64, rows: int | None = None) -> DataFrame:
    """df with `vector`, of norm 1 (a zero vector stays zero).

    encoder(dim) is called once per worker process; what it returns takes an Arrow array of texts as they stand in the
    table (null: empty) and gives their vectors. rows: how many texts it takes at once, sorted by length, so that a model
    pads little; the default takes what Arrow brings.
    """
    make = encoder or hash_encoder

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make(dim)
        for texts in batches:
            out = np.zeros((len(texts), dim))
            for at in by_length(texts, rows):
                out[at] = encode(texts.take(pa.array(at)) if rows else texts.slice(at[0], len(at)))
            n = np.sqrt((out * out).sum(1, keepdims=True))
            out /= np.where(n == 0, 1e-12, n)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return df.withColumn("vector", run(F.coalesce(text_col, F.lit(""))))


def embed_queries(queries: DataFrame, query_col: str = "query", encoder: Callable[[int], Encode] | None = None, *, prefix: str = "", dim: int = 64, rows: int | None = None) -> DataFrame:
    """Query side: the same with an instruction in front, for encoders that need one."""
    return embed(queries.withColumn("__q", F.concat(F.lit(prefix), F.col(query_col))), "__q", encoder, dim=dim, rows=rows).drop("__q")


def check_dimension(chunks: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector has the dimension, and those to reject (null vectors, too)."""
    fits = F.coalesce(F.size("vector") == dim, F.lit(False))
    return chunks.where(fits), chunks.where(~fits)
