"""Importance resampling of documents towards a target collection, on hashed runs of words.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. A text's features are all its runs of
1 to `longest` successive words joined by one blank, repeats counted; a feature's bucket is its CRC-32 modulo `buckets`.
Each document is brought to words with single blanks between them and scanned once with a running CRC; the CRC of every
feature comes from the registers at its two ends (prefixcrc). A bucket that is commoner in the target gains, and a
document weighs the mean gain of its features. Seeded Gumbel noise on the weight makes the highest scores a sample
without replacement, in proportion to the importance.

Two passes over the texts: the first sends at most `buckets` sums per task, the second one slim row per document. The
sums of all buckets (their number is a parameter) are the only thing that reaches the driver. Ranks come from a sort by
ranges with offsets, so no task sees all documents.

Defined results: a null or empty text has no features and weighs 0; documents with too few words, or without an id, have
no rank, and those without an id no score; rows that share an id are ranked each by itself; ties go to the smaller id;
a text of any length is scanned in pieces of bounded size; an empty target leaves all gains to the smoothing; an empty
table gives no rows; of the documents only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .prefixcrc import RunningCrc, behind, between
from .session import checkpointed
from .textkit import _LOWER, NOT_ALNUM, Words, buffers, ragged, slices, sum_by

BUCKETS = 10_000
LONGEST = 2  # words of a feature
PERCENT, LEAST_WORDS = 25, 20
SEED = 7
PIECE = 4 << 20  # bytes scanned together


def feature_crcs(words: Words, longest: int = LONGEST, piece: int = PIECE):
    """(text, CRC-32) of every feature, in pieces that begin with words and hold about `piece` bytes."""
    size = words.ends - words.starts
    if not len(size):
        return
    docs = words.docs()
    until = words.ptr[1:][docs]  # the end of each word's text
    filled = np.cumsum(size + 1)
    cuts = np.flatnonzero(np.diff(filled // piece, prepend=0)) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(size)]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k = min(j + longest - 1, len(size))  # runs may end in the next piece
        taken = size[i:k] + 1
        data = _LOWER[words.data[np.minimum(ragged(words.starts[i:k], taken), len(words.data) - 1)]]
        ends = np.cumsum(taken) - 1
        data[ends] = 32
        at_end = RunningCrc(data).at(ends)
        at_start = np.concatenate([np.zeros(1, np.uint32), behind(at_end[:-1], 32)])
        starts = ends - size[i:k]
        for n in range(1, longest + 1):
            first = np.flatnonzero(np.arange(i, j) + n <= until[i:j])
            last = first + n - 1
            yield docs[i:j][first], between(at_start[first], at_end[last], ends[last] - starts[first])


def _words(column: pa.Array) -> Words:
    return Words(*buffers(column), NOT_ALNUM)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): features of all texts, summed in each task."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for _, crc in feature_crcs(_words(batch.column(0)), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str, buckets: int, longest: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    here = bucket_counts(docs, text_col, buckets, longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    there = bucket_counts(target, target_text_col, buckets, longest).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in here.unionByName(there).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most `buckets` rows
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    of_s, of_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_s / ((a + 1.0) * of_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    gains = bucket_gains(docs, target, text_col, target_text_col, buckets, longest)

    def weigh(batches):
        for batch in slices(batches, "text"):
            words, rows = _words(batch.column("text")), batch.num_rows
            n, gained = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for doc, crc in feature_crcs(words, longest):
                n += np.bincount(doc, minlength=rows)
                gained += sum_by(doc, gains[crc % np.uint32(buckets)], rows).astype(np.int64)  # of a piece: exact in a double
            weight = np.where(n > 0, gained // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.counts.astype(np.int64)), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """importance_scores with rank: 1, 2, 3... for the drawn documents, null for the others."""
    scored = checkpointed(importance_scores(docs, target, id_col, text_col, target_text_col, **options).withColumn("able", (F.col("n_words") >= least_words) & F.col(id_col).isNotNull()))
    drawn = scored.where("able").count() * percent // 100
    order = [F.desc("able"), F.desc("score"), F.col(id_col).asc(), F.col("n_features").asc(), F.col("weight").asc(), F.col("n_words").asc()]
    rank = F.when(F.col("able") & (F.col("number") < drawn), F.col("number") + 1)
    return numbered(scored, order).select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", **options) -> DataFrame:
    """The rows of the documents that are drawn, with all their columns; rows that share a drawn id all stay."""
    ranked = resample(docs, target, id_col, text_col, target_text_col, **options).where("rank is not null")
    return docs.join(ranked.select(id_col).distinct(), id_col, "left_semi")
