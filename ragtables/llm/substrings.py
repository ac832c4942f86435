"""Removal of passages that an earlier document already has, found by difference-cover anchors.

A passage is a window of `length` words. Hashing every window would shuffle one
row per word. A difference cover D modulo a period v has, for any two positions,
a shift below v that brings both into D; so if only the positions of D (modulo
v) get an anchor of length - v + 1 words, any two equal windows, wherever they
lie, still share an aligned anchor. Three steps, each one exchange of packed arrays:

1. anchors, grouped by hash: those of two or more documents are candidates;
2. candidates extended to whole windows: 128-bit window fingerprints, grouped,
   give the smallest document that has each;
3. each document drops the words under windows that a smaller document has.

A batch first settles what it can see itself and sends at most two documents
per anchor, and one per window, so a passage in a third of all documents does
not flood a bucket.

Defined results: a null or empty text has no words and is kept as it is; rows
without an id are kept unchanged and are no evidence; rows that share an id
count as one document; an empty table gives no rows; result columns replace
input columns of the same name (counts gives the names of the two counts).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Words, buffers, full_windows, mix, pack, ragged, slices, spread, unpack, windows

LENGTH = 13


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences modulo the period are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


class _Text:
    """A slice of documents with the fingerprints of their words."""

    def __init__(self, ids: np.ndarray, column: pa.Array, length: int):
        self.ids, self.length, self.period = ids, length, max(1, (length + 1) // 2)
        self.words = Words(*buffers(column))
        self.hashes = self.words.hashes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word index, document index and fingerprint of each anchor."""
        w, size = self.words, self.length - self.period + 1
        count = np.where(w.counts >= self.length, w.counts - size + 1, 0)
        at = ragged(w.ptr[:-1], count)
        doc = np.repeat(np.arange(len(count)), count)
        ours = np.zeros(self.period, bool)
        ours[list(difference_cover(self.period))] = True
        chosen = ours[(at - w.ptr[doc]) % self.period]
        at, doc = at[chosen], doc[chosen]
        return at, doc, windows(self.hashes, size)[at] if len(at) else np.zeros(0, np.uint64)


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else column.combine_chunks().to_numpy().astype(np.int64)


def _key(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64)) ^ mix(hashes + np.uint64(1))


def _by(part: np.ndarray):
    """Positions of the entries of each part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield int(part[order[i]]), order[i:j]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (first one leads), run starts, and each ordered entry's run."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


_SENT = "bucket int, home int, docs binary, hashes binary, more binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("home", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("more", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


_PRIME, _FACTOR = 2147483647, 48271


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return np.mod(np.mod(ids, _PRIME) * _FACTOR, _PRIME) % homes


def _spot(ids, homes: int):
    """The same as a column."""
    return F.pmod(F.pmod(F.pmod(ids, F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME)), F.lit(homes))


def _known(ids: np.ndarray, hashes: np.ndarray, homes: int, buckets: int, salt: int) -> list[tuple]:
    """Rows that pass through the bucket exchange as they are; home >= 0 marks them."""
    return [((h * 31 + salt) % buckets, h, pack(ids[x]), pack(hashes[x]), b"") for h, x in _by(_home(ids, homes))] if len(ids) else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """docs with repeated passages cut out of the text, and how many words it had and lost, in columns named by counts."""
    spark = docs.sparkSession
    buckets, homes = spread(spark, 1), spread(spark)
    docs = docs.drop(*counts)
    others = [c for c in docs.columns if c not in (id_col, text_col)]

    def anchors(batches):
        """Candidate anchors known here (home >= 0), and for each bucket the anchors to compare."""
        for n, batch in enumerate(slices(batches, "__text")):
            t = _Text(_ids(batch.column(0)), batch.column("__text"), length)
            _, doc, a = t.anchors()
            ids = t.ids[doc]
            order = np.lexsort((ids, a))
            a, ids = a[order], ids[order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])
            a, ids = a[once], ids[once]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            last = np.ones(len(a), bool)
            last[:-1] = new[1:]
            shared = ~(new & last)
            rows = _known(ids[shared], (a[shared] & np.uint64(0xFFFFFFFF)).astype(np.uint32), homes, buckets, n)
            ends = new | last
            a, ids = a[ends], ids[ends]
            for b, x in _by((a >> np.uint64(32)).astype(np.int64) % buckets):
                x = x[np.argsort(ids[x], kind="stable")]
                rows.append((b, -1, pack(np.diff(ids[x], prepend=0)), pack((a[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), b""))
            if rows:
                yield _rows(rows)

    def common_anchors(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.greater_equal(table["home"], 0))
        fresh = table.filter(pa.compute.less(table["home"], 0))
        rows = []
        if fresh.num_rows:
            ids = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in fresh["docs"].to_pylist()])
            a = unpack(fresh["hashes"], np.uint32)
            order = np.argsort(a, kind="stable")
            a, ids = a[order], ids[order]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(np.append(start, len(a)))
            mixed = np.repeat(np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start), size)
            rows = _known(ids[mixed], a[mixed], homes, buckets, 0)
        return pa.concat_tables([known, pa.Table.from_batches([_rows(rows)])])

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Window fingerprints of the candidates of these documents."""
        rows, n = [], 0
        found = np.sort(_key(unpack(right["docs"], np.int64), unpack(right["hashes"], np.uint32).astype(np.uint64)))
        for batch in slices(left.to_batches(), "__text") if len(found) else ():
            t = _Text(_ids(batch.column("__id")), batch.column("__text"), length)
            at, doc, a = t.anchors()
            hit = np.isin(_key(t.ids[doc], a & np.uint64(0xFFFFFFFF)), found)
            size = t.length - t.period + 1
            mark = np.zeros(len(t.hashes) + 1, np.int64)
            np.add.at(mark, np.maximum(at[hit] - (length - size), t.words.ptr[doc[hit]]), 1)
            np.add.at(mark, at[hit] + 1, -1)
            starts = full_windows(t.words.ptr, length)
            starts = starts[np.cumsum(mark)[starts] > 0]
            if not len(starts):
                continue
            ids = t.ids[np.searchsorted(t.words.ptr, starts, side="right") - 1]
            h, g = windows(t.hashes, length)[starts], windows(t.words.hashes(seed=1), length, 1)[starts]
            order, first, run = _runs(h, g, ids)
            h, g, ids = (x[order[first]] for x in (h, g, ids))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            n += 1
            rows += _known(ids[~new], h[~new], homes, buckets, n)
            h, g, ids = h[new], g[new], ids[new]
            for b, x in _by((h >> np.uint64(32)).astype(np.int64) % buckets):
                rows.append((b, -1, pack(ids[x]), pack(h[x]), pack(g[x])))
        return pa.Table.from_batches([_rows(rows)])

    def later_windows(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.greater_equal(table["home"], 0))
        fresh = table.filter(pa.compute.less(table["home"], 0))
        rows = []
        if fresh.num_rows:
            ids, h, g = unpack(fresh["docs"], np.int64), unpack(fresh["hashes"], np.uint64), unpack(fresh["more"], np.uint64)
            order, first, run = _runs(h, g)
            ids, h = ids[order], h[order]
            late = ids > np.minimum.reduceat(ids, first)[run]
            rows = _known(ids[late], h[late], homes, buckets, 0)
        return pa.concat_tables([known, pa.Table.from_batches([_rows(rows)])])

    schema = T.StructType([*[f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema], *(T.StructField(c, T.LongType()) for c in counts)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = np.sort(_key(unpack(right["docs"], np.int64), unpack(right["hashes"], np.uint64)))
        for batch in slices(left.to_batches(), "__text"):
            column = batch.column("__id")
            t = _Text(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("__text"), length)
            w, gone = t.words, np.zeros(len(t.hashes), bool)
            starts = full_windows(w.ptr, length)
            if len(found) and len(starts):
                doc = np.searchsorted(w.ptr, starts, side="right") - 1
                hit = starts[np.isin(_key(t.ids[doc], windows(t.hashes, length)[starts]), found) & column.is_valid().to_numpy(zero_copy_only=False)[doc]]
                edge = np.zeros(len(gone) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.ptr])
            texts = batch.column("__text")
            if removed.any():
                # a removed word takes the white space behind it along
                nexts = np.append(w.starts[1:], len(w.data))
                nexts = np.minimum(nexts, t.words.offsets[1:][w.docs()])
                keep = np.ones(len(w.data), bool)
                keep[ragged(w.starts[gone], (nexts - w.starts)[gone])] = False
                new = pa.Array.from_buffers(pa.large_string(), len(removed), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(keep)])[w.offsets].astype(np.int64)), pa.py_buffer(w.data[keep])])
                texts = pa.compute.if_else(pa.array(removed > 0), new, texts.cast(pa.large_string())).cast(pa.string())
            columns = {c: batch.column("__row").field(others.index(c)) if others else None for c in others}
            columns |= {id_col: column, text_col: texts, counts[0]: pa.array(w.counts, pa.int64()), counts[1]: pa.array(removed, pa.int64())}
            out.append(pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema]))
        return pa.Table.from_batches(out)

    home = F.coalesce(_spot(F.col(id_col).cast("long"), homes), F.pmod(F.xxhash64(text_col), F.lit(homes))).cast("int")
    homed = docs.select(home.alias("home"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *([F.struct(*others).alias("__row")] if others else [])).groupBy("home")
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    candidates = read.mapInArrow(anchors, _SENT).groupBy("bucket").applyInArrow(common_anchors, _SENT).where("home >= 0")
    spans = homed.cogroup(candidates.groupBy("home")).applyInArrow(extend, _SENT)
    late = spans.groupBy("bucket").applyInArrow(later_windows, _SENT).where("home >= 0")
    return homed.cogroup(late.groupBy("home")).applyInArrow(cut, schema)


def removal_digest(cut: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the counts and the SHA-256 of the words that stay, joined by one blank."""
    words = F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select(id_col, "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))
