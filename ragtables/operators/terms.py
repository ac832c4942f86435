"""Which texts contain which terms: an inverted index from the rarest eight bytes of each term, then an exact check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import KEEP, bytes_of, eights, mixed, ragged

#: Terms that every task looks for at once; more are looked for in rounds of this many.
TERM_BLOCK = 100_000
SLICE = 2 << 20  # bytes of text searched together
PAIRS = 1 << 21  # candidates checked together
_BITS = np.uint64(44)  # leaves 20 bits


class TermIndex:
    """Finds terms (as lower-case bytes) in texts.

    Every term is entered under one gram: its rarest run of eight bytes among all terms, or itself if it is shorter. The
    grams of a text are looked up, and each term behind a gram is compared byte for byte where it would have to stand.
    """

    def __init__(self, terms: list[str]):
        self.data, offsets = bytes_of(pa.array(terms, pa.string()))
        self.start, self.size = offsets[:-1], np.diff(offsets)
        self.eight = eights(self.data)
        self.empty = np.flatnonzero(self.size == 0)
        at = np.zeros(len(terms), np.int64)  # where a term's gram stands in it
        long = np.flatnonzero(self.size > 8)
        if len(long):
            runs = self.size[long] - 7
            places = ragged(self.start[long], runs)
            _, code, count = np.unique(self.eight[places], return_inverse=True, return_counts=True)
            order = np.lexsort((places, count[code], np.repeat(long, runs)))
            best = order[np.cumsum(runs) - runs]
            at[long] = places[best] - self.start[long]
        self.at, self.widths = at, []
        for w in np.unique(np.minimum(self.size, 8)).tolist():
            if w:
                mine = np.flatnonzero(np.minimum(self.size, 8) == w)
                gram = self.eight[(self.start + at)[mine]] & KEEP[w]
                mine = mine[np.argsort(gram, kind="stable")]
                gram, first, count = np.unique(np.sort(gram), return_index=True, return_counts=True)
                seen = np.zeros(1 << 20, bool)
                seen[mixed(gram) >> _BITS] = True
                self.widths.append((w, gram, first, count, mine, seen))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, row) of every term in every row, once each; not the empty terms."""
        found, eight, n = [np.zeros((2, 0), np.int64)], eights(data), len(data)
        for w, gram, first, count, mine, seen in self.widths:
            keys = eight[:n] & KEEP[w]
            places = np.flatnonzero(seen[mixed(keys) >> _BITS])
            spot = np.minimum(np.searchsorted(gram, keys[places]), len(gram) - 1)
            fits = gram[spot] == keys[places]
            places, spot = places[fits], spot[fits]
            upto = np.cumsum(count[spot])
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(upto // PAIRS, prepend=0)) + 1, [len(spot)]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                term = mine[ragged(first[spot[i:j]], count[spot[i:j]])]
                begin = np.repeat(places[i:j], count[spot[i:j]])
                row = np.searchsorted(offsets, begin, side="right") - 1
                begin = begin - self.at[term]
                live = np.flatnonzero((begin >= offsets[row]) & (begin + self.size[term] <= offsets[row + 1]))
                term, begin, row = term[live], begin[live], row[live]
                same, off, open_ = np.ones(len(term), bool), 0, np.arange(len(term))
                while len(open_):
                    left = KEEP[np.minimum(self.size[term[open_]] - off, 8)]
                    same[open_] = ((eight[begin[open_] + off] ^ self.eight[self.start[term[open_]] + off]) & left) == 0
                    off += 8
                    open_ = open_[same[open_] & (self.size[term[open_]] > off)]
                found.append(np.unique(np.stack([term[same], row[same]]), axis=1))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def text_slices(column: pa.Array):
    """Pieces (first row, array) of about SLICE bytes, or of one text."""
    size = np.diff(bytes_of(column)[1])
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0)) + 1, [len(size)]]))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield i, column.slice(i, j - i)


def term_presence(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, chunks): number of chunks that contain each term, ignoring case; terms that are nowhere count 0.

    Blocks of about TERM_BLOCK terms, dealt by hash, are looked for one after the other in every chunk where it is read.
    A null term is in no chunk, an empty one in all that have a text.
    """
    spark, asked = chunks.sparkSession, terms.select("term").distinct()
    blocks = max(1, -(-asked.count() // TERM_BLOCK))
    texts, found = chunks.where("text is not null").select(F.lower("text").alias("text")), None
    for i in range(blocks):
        mine = asked.where(F.col("term").isNotNull() & (F.pmod(F.xxhash64("term"), F.lit(blocks)) == i))
        rows = mine.select("term", F.lower("term").alias("low")).collect()  # at most about TERM_BLOCK rows
        part = texts.mapInArrow(_counter(spark.sparkContext.broadcast([tuple(r) for r in rows])), "term string, chunks long")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("term").agg(F.sum("chunks").alias("chunks"))
    return asked.join(found, "term", "left").select("term", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def _counter(listed):
    def count(batches):
        terms, index = [t for t, _ in listed.value], TermIndex([low for _, low in listed.value])
        n, texts = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, column in text_slices(batch.column("text")):
                n += np.bincount(index.find(*bytes_of(column))[0], minlength=len(terms))
        n[index.empty] = texts
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([terms[i] for i in at.tolist()], pa.string()), pa.array(n[at])], names=["term", "chunks"])

    return count
