"""Near-duplicate documents by Order MinHash with alignment of the candidates.

Each text is seen as its runs of five words, each labelled with how often it
has occurred before. For each of `hashes` functions the two smallest labelled
runs are kept in the order in which the text has them, so the sketch follows
edit similarity and not only the sets. Texts that agree
on an entry (or a band of several) meet in a bucket.

The text with the smallest id leads its bucket and is paired with every other
text there, however few entries they share, unless the counts of their words in
64 classes rule the similarity out: a word that one side has more often costs an
edit, so no pair is lost by that. Texts whose sketch agrees with the leader's in
at least half of the entries step back, the rest look for a next leader, until
none is left. Who stepped back but is not verified into the leader's class goes on
inside a batch as one more leader; between batches it is compared through that leader
only, as comparing it with all others there grows with the square of a crowd. This is done first
inside each batch of documents, where pairs are verified at once and joined to
classes, so only leaders travel: copies in a third of all rows reduce to one row
per batch and band, and to one node per batch in the graph of links.

Between batches, pairs that agree in a third of the entries are verified first.
The others travel packed and are verified unless the first have already put
both texts into one class, where a further link changes nothing.

Pairs are verified on the whole texts: similarity = 1 - edit distance over
words / words of the longer text >= 0.8, the distance by banded alignment. Equal
texts need none. Classes are the connected components of the verified pairs.

Defined results: texts without words (also null) and rows without an id are in
no class of others; rows that share an id count as one document; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, salted_join
from .textkit import Words, buffers, mix, pack, slices, spread, unpack, windows

SHINGLE, SIMILARITY = 5, 0.8
HASHES, PER_BAND = 24, 1
BINS = 64  # classes of words that are counted per text


def sketches(words: Words, shingle: int = SHINGLE, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with words, a 64-bit sketch row for each (documents x hashes), and 128-bit text fingerprints."""
    h = words.hashes()
    docs = np.flatnonzero(words.counts)
    n = np.maximum(words.counts[docs] - shingle + 1, 1)
    begin = np.cumsum(n) - n
    total = int(n.sum())
    doc = np.repeat(np.arange(len(docs)), n)
    # a text shorter than the shingle is one run of all its words
    short = words.counts[docs] < shingle
    runs = np.zeros(total, np.uint64)
    place = np.arange(total) - begin[doc] + words.ptr[docs][doc]
    full = ~short[doc]
    if full.any():
        runs[full] = windows(h, shingle)[place[full]]
    # fingerprints must not depend on where the text lies in the batch: weigh words by their place in the text
    local = (np.arange(len(h)) - words.ptr[words.docs()]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    prints = np.empty((len(docs), 2), np.uint64)
    for k in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(k + 5)) * mix(local + np.uint64(k)))])
        prints[:, k] = mix(sums[words.ptr[docs + 1]] - sums[words.ptr[docs]] + np.uint64(k))
    runs[begin[short]] = prints[short, 0]
    # occurrence labels
    order = np.lexsort((runs, doc))
    same = np.zeros(total, bool)
    same[1:] = (runs[order][1:] == runs[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    at = np.arange(total)
    label = np.empty(total, np.int64)
    label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    labelled = np.where(label > 0, mix(runs + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), runs)
    out = np.empty((len(docs), hashes), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(hashes):
        g = labelled * np.uint64(2 * (j * 0x5851F42D4C957F2D % (1 << 62)) + 1)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        one = np.minimum.reduceat(g, begin)
        where = np.flatnonzero(g == one[doc])
        first = np.empty(len(docs), np.int64)
        first[doc[where]] = where
        g[first] = top
        two = np.minimum.reduceat(g, begin)
        where = np.flatnonzero(g == two[doc])
        second = np.empty(len(docs), np.int64)
        second[doc[where]] = where  # a text of one run has it twice
        a, b = np.minimum(first, second), np.maximum(first, second)
        out[:, j] = mix(runs[a] * np.uint64(3) + mix(runs[b] + np.uint64(j)))
    return docs, out, prints


_SENT = "bucket int, kind int, ids binary, roots binary, keys binary, prints binary, sketches binary, sizes binary, bins binary"
_FOUND = "kind int, part int, a binary, b binary, ra binary, rb binary, equal binary"
_WEAK = "part int, a binary, b binary, ra binary, rb binary, ca binary"


def word_bins(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Per text how often it has words of each class, at most 255 (a bound on both sides cannot raise a difference)."""
    n = len(ptr) - 1
    at = np.repeat(np.arange(n), np.diff(ptr)) * BINS + (hashes >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def within_counts(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether rows of word counts leave an edit distance of `most` possible: words on one side only cost an edit each."""
    d = x.astype(np.int16) - y
    more = np.maximum(d, 0).sum(1)
    return np.maximum(more, more - d.sum(1)) <= most


def _lead(key: np.ndarray, ids: np.ndarray, sketch, prints, sizes: np.ndarray, bins, similarity: float):
    """Leaders of each bucket key and the pairs found on the way.

    sketch: short integer rows, one per entry; bins: word counts. Returns positions of the leaders, rows (leader, other,
    equal texts, little agreement) of positions to pair, and rows (leader, other) where the other stepped back.
    """
    alive, leaders, pairs, behind = np.lexsort((ids, key)), [], [], []
    hashes = sketch.shape[1]
    while len(alive):
        k = key[alive]
        new = np.ones(len(alive), bool)
        new[1:] = k[1:] != k[:-1]
        lead = alive[np.flatnonzero(new)][np.cumsum(new) - 1]
        leaders.append(alive[new])
        lead, others = lead[~new], alive[~new]
        if not len(others):
            break
        agree = (sketch[lead] == sketch[others]).sum(1)
        equal = (prints[lead] == prints[others]).all(1)
        a, b = sizes[lead], sizes[others]
        most = np.floor((1 - similarity) * np.maximum(a, b) + 1e-9)
        tell = (np.abs(a - b) <= most) | equal
        for i in range(0, len(tell), 1 << 16):
            x = i + np.flatnonzero(tell[i : i + (1 << 16)])
            tell[x] = within_counts(bins[lead[x]], bins[others[x]], most[x])
        pairs.append(np.stack([lead[tell], others[tell], equal[tell], (agree < hashes // 3)[tell] & ~equal[tell]], 1))
        back = (agree >= hashes // 2) & tell
        behind.append(np.stack([lead[back], others[back]], 1))
        alive = others[~back]
    none = np.zeros((0, 4), np.int64)
    return np.concatenate([none[:, 0], *leaders]), np.unique(np.concatenate([none, *pairs]), axis=0), np.concatenate([none[:, :2], *behind])


class _Forest:
    """Union-find over the documents of a batch."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(j)] = self.root(i)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two word sequences align to at least the similarity."""
    longer = max(len(x), len(y))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    return longer > 0 and alignment_within(x, y, most) <= most


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])


def candidates(docs: DataFrame, id_col: str, text_col: str, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES, per_band: int = PER_BAND) -> DataFrame:
    """Packed rows (kind, part, a, b, ra, rb, equal).

    kind 1: a is a verified member of the class that b leads within one batch of documents. Else a and b are of different
    batches and are to be verified (unless their texts are equal); ra and rb lead their classes in their batches. Kind 0
    are pairs of texts that agree in a third of their sketches, kind 2 the others, in parts by ra.
    """
    buckets = spread(docs.sparkSession, 1)
    bands = hashes // per_band

    def sketch(batches):
        for n, batch in enumerate(slices(batches, "__text", 4 << 20)):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = Words(*buffers(batch.column("__text")))
            own, full, prints = sketches(words, shingle, hashes)
            if not len(own):
                continue
            tokens, ptr, size = words.hashes(), words.ptr, words.counts[own]
            tokens, bins = tokens.view(np.int64), word_bins(tokens, ptr)[own]
            ids, small = ids[own], (full & np.uint64(0xFFFF)).astype(np.uint16)
            key = np.empty((len(own), bands), np.uint64)
            for b in range(bands):
                k = np.full(len(own), b + 1, np.uint64)
                for j in range(per_band):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + full[:, b * per_band + j])
                key[:, b] = k
            # all bands at once: entries are (document, band)
            flat, at = key.ravel(), np.repeat(np.arange(len(own)), bands)
            leaders, pairs, behind = _lead(flat, ids[at], _Rows(small, at), _Rows(prints, at), size[at], _Rows(bins, at), similarity)
            pairs[:, :2] = at[pairs[:, :2]]
            forest = _Forest(len(own))
            pairs = np.unique(pairs, axis=0)
            for i, j, equal, _ in pairs[np.lexsort((pairs[:, 3], -pairs[:, 2]))].tolist():
                if forest.root(i) != forest.root(j):
                    if equal or similar(tokens[ptr[own[i]] : ptr[own[i] + 1]], tokens[ptr[own[j]] : ptr[own[j] + 1]], similarity):
                        forest.join(i, j)
            root = np.array([forest.root(i) for i in range(len(own))])
            first = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(first, root, ids)
            roots = first[root]
            # who stepped back but is in another class after all goes on
            apart = root[at[behind[:, 0]]] != root[at[behind[:, 1]]]
            leaders = np.unique(np.concatenate([leaders, behind[apart, 1]]))
            member = roots != ids
            rows = [(n % buckets, 1, pack(ids[member]), pack(roots[member]), b"", b"", b"", b"", b"")] if member.any() else []
            k, d = flat[leaders], at[leaders]
            part = (k % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1))
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                x = order[i:j]
                rows.append((int(part[order[i]]), 0, pack(ids[d[x]]), pack(roots[d[x]]), pack(k[x]), pack(prints[d[x]]), pack(small[d[x]]), pack(size[d[x]].astype(np.int64)), pack(bins[d[x]])))
            yield _batch(_SENT, rows)

    def meet(table: pa.Table) -> pa.Table:
        local = table.filter(pc.equal(table["kind"], 1))
        rows = [(1, 0, a, b, b"", b"", b"") for a, b in zip(local["ids"].to_pylist(), local["roots"].to_pylist(), strict=True)]
        fresh = table.filter(pc.equal(table["kind"], 0))
        if fresh.num_rows:
            ids, roots, key = unpack(fresh["ids"], np.int64), unpack(fresh["roots"], np.int64), unpack(fresh["keys"], np.uint64)
            order = np.argsort(key, kind="stable")
            s = key[order]
            many = np.zeros(len(s), bool)
            many[1:] |= s[1:] == s[:-1]
            many[:-1] |= s[1:] == s[:-1]
            x = order[many]  # most keys have one text
            if len(x):
                prints, small = unpack(fresh["prints"], np.uint64).reshape(-1, 2), unpack(fresh["sketches"], np.uint16).reshape(-1, hashes)
                ids, roots, sizes = ids[x], roots[x], unpack(fresh["sizes"], np.int64)[x]
                bins = unpack(fresh["bins"], np.uint8).reshape(-1, BINS)[x]
                pairs = _lead(key[x], ids, small[x], prints[x], sizes, bins, similarity)[1]
                i, j = pairs[:, 0], pairs[:, 1]
                pairs = pairs[roots[i] != roots[j]]
                i, j = pairs[:, 0], pairs[:, 1]
                found = np.unique(np.stack([pairs[:, 3], ids[i], ids[j], roots[i], roots[j], pairs[:, 2]], 1), axis=0)
                rows.append((0, 0, *(pack(c) for c in found[found[:, 0] == 0, 1:].T)))
                found = found[found[:, 0] == 1, 1:]
                rows += [(2, part, *(pack(c) for c in x.T)) for part, x in _parts(found[:, 2], found, buckets)]
        return pa.Table.from_batches([_batch(_FOUND, rows)])

    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text"))
    return read.mapInArrow(sketch, _SENT).groupBy("bucket").applyInArrow(meet, _FOUND)


def _parts(key: np.ndarray, rows: np.ndarray, parts: int):
    """(part, its rows) by the remainder of the key."""
    if not len(key):
        return
    part = key % parts
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield int(part[order[i]]), rows[order[i:j]]


def expanded(found: DataFrame) -> DataFrame:
    """Rows (known, a, b, ra, rb, equal) of the packed rows of kind 0 and 1."""

    def expand(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)
                if row["kind"]:
                    columns = [np.ones(len(a), bool), a, b, a, b, np.ones(len(a), bool)]
                else:
                    columns = [np.zeros(len(a), bool), a, b, np.frombuffer(row["ra"], np.int64), np.frombuffer(row["rb"], np.int64), np.frombuffer(row["equal"], np.int64) > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["known", "a", "b", "ra", "rb", "equal"])

    rows = found.where("kind < 2").mapInArrow(expand, "known boolean, a long, b long, ra long, rb long, equal boolean")
    return rows.groupBy("known", "a", "b", "ra", "rb").agg(F.max("equal").alias("equal"))


def between(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (a, b, ra, rb, equal) of the packed rows of kind 2 whose classes are not yet one. classes: id, class_id."""
    parts = spread(found.sparkSession, 1)
    known = classes.select("id", "class_id", F.pmod("id", F.lit(parts)).cast("int").alias("part")).groupBy("part")
    names = ("a", "b", "ra", "rb", "ca")

    def labels(nodes: np.ndarray, table: pa.Table) -> np.ndarray:
        if not table.num_rows:
            return nodes
        ids, to = (table[c].to_numpy() for c in ("id", "class_id"))
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, nodes, sorter=order), len(ids) - 1)]
        return np.where(ids[at] == nodes, to[at], nodes)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = np.unique(np.stack([unpack(left[c], np.int64) for c in names[:4]], 1), axis=0) if left.num_rows else np.zeros((0, 4), np.int64)
        rows = np.hstack([rows, labels(rows[:, 2], right)[:, None]])
        return pa.Table.from_batches([_batch(_WEAK, [(part, *(pack(c) for c in x.T)) for part, x in _parts(rows[:, 3], rows, parts)])])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, ra, rb, ca = (unpack(left[c], np.int64) for c in names)
        apart = labels(rb, right) != ca
        return pa.table({n: c[apart] for n, c in zip(names, (a, b, ra, rb), strict=False)})

    weak = found.where("kind = 2").select("part", "a", "b", "ra", "rb").groupBy("part")
    half = weak.cogroup(known).applyInArrow(first, _WEAK).groupBy("part")
    return half.cogroup(known).applyInArrow(second, "a long, b long, ra long, rb long").distinct().withColumn("equal", F.lit(False))


class _Rows:
    """Rows of an array by an index, without the repeated copy."""

    def __init__(self, rows: np.ndarray, at: np.ndarray):
        self.rows, self.at, self.shape = rows, at, (len(at), rows.shape[1])

    def __getitem__(self, i):
        return self.rows[self.at[i]]


def alignment_within(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    front = int(differ[0]) if len(differ) else n
    x, y = x[front:], y[front:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    back = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - back], y[: len(y) - back]
    if len(x) > len(y):
        x, y = y, x
    gap = len(y) - len(x)
    if gap > most:
        return most + 1
    if not len(x):
        return gap
    # words that only one side has each cost an edit: a bound that settles most unrelated pairs
    a, b = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    if len(y) - int(np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()) > most:
        return most + 1
    few = min(most, 6)  # furthest-reaching diagonals while the distance is small
    n, m, reach = len(x), len(y), {0: 0}
    for d in range(few + 1):
        if d:
            nxt = {}
            for k in range(max(-d, -n), min(d, m) + 1):  # diagonal: place in y minus place in x
                i = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
                if 0 <= i <= n and i + k <= m:
                    nxt[k] = i
            reach = nxt
        for k, i in reach.items():
            if 0 <= i + k < m and i < n and x[i] == y[i + k]:
                width = 16
                while True:
                    part = x[i : i + width]
                    other = y[i + k : i + k + len(part)]
                    part = part[: len(other)]
                    off = np.flatnonzero(part != other)
                    if len(off):
                        i += int(off[0])
                        break
                    i += len(part)
                    if not len(part) or i >= n or i + k >= m:
                        break
                    width *= 4
                reach[k] = i
        if reach.get(gap, -1) >= n:
            return d
    if few == most:
        return most + 1
    band = 16
    while True:  # a band around the diagonal that widens until the distance fits
        band = min(most, band * 4)
        d = _banded(x.tolist(), y.tolist(), band)
        if d <= band or band == most:
            return d if d <= most else most + 1


def _banded(text: list[int], pattern: list[int], k: int) -> int:
    """Edit distance inside the band |place in pattern - place in text| <= k: right if it is at most k, else too large.

    The band's column is held as the bits of integers: where the distance rises or falls from one place of the pattern
    to the next. Bit b stands for place i - k + b at step i, so the window moves along the diagonal.
    """
    at: dict[int, int] = {}
    for j, c in enumerate(pattern, 1):
        at[c] = at.get(c, 0) | 1 << (j + k)
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    fall = (1 << (k + 1)) - 1  # places before the pattern's start: one less each, so that its start costs i at step i
    rise = full ^ fall
    low = k  # the distance at bit 0
    for i, c in enumerate(text, 1):
        up, down = rise >> 1 | top, fall >> 1
        here = at.get(c)
        x = down if here is None else ((here >> i) & full) | down
        same = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(same | up)), up & same
        right = (right << 1 | 1) & full
        rise, fall = ((left << 1) | ~(same | right)) & full, right & same
        low += 1 - (same & 1)
    upto = (1 << (len(pattern) - len(text) + k + 1)) - 2
    return low + (rise & upto).bit_count() - (fall & upto).bit_count()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the batch classes of those pairs (a, b, ra, rb, equal) whose whole texts align."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def align(batches):
        for batch in slices(batches, "ta", 4 << 20):
            left, right = Words(*buffers(batch.column("ta"))), Words(*buffers(batch.column("tb")))
            x, y = left.hashes().view(np.int64), right.hashes().view(np.int64)
            ok = [similar(x[left.ptr[i] : left.ptr[i + 1]], y[right.ptr[i] : right.ptr[i + 1]], similarity) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(ok, pa.bool_())) for c in ("ra", "rb")], names=["a", "b"])

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias("t" + c)) for c in ("a", "b"))
    with_texts = pairs.where("not equal").select("a", "b", "ra", "rb").join(left, "a").join(right, "b").select("ra", "rb", "ta", "tb")
    return pairs.where("equal").select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(with_texts.mapInArrow(align, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id of the connected component of each linked id.

    Each round hangs every node's larger neighbours, then its smaller ones and
    itself, below the smallest neighbour, which shortens paths exponentially; it
    ends when nothing moves.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def beside_least(rows: DataFrame) -> DataFrame:
        """rows with m, the smallest neighbour; the neighbours of one node are dealt to several tasks."""
        return salted_join(rows, rows.groupBy("u").agg(F.min("v").alias("m")), ["u"], "v")

    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = beside_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = beside_least(large)
        edges = checkpointed(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES, per_band: int = PER_BAND) -> DataFrame:
    """For each document (id): class_id, the smallest id of its class, and whether it stays (is that one)."""
    packed = checkpointed(candidates(docs, id_col, text_col, similarity=similarity, shingle=shingle, hashes=hashes, per_band=per_band))
    found = checkpointed(expanded(packed))
    classes = components(verified(found.where("not known"), docs, id_col, text_col, similarity))
    more = verified(between(packed, classes), docs, id_col, text_col, similarity)
    classes = components(more.unionByName(classes.select(F.col("id").alias("a"), F.col("class_id").alias("b"))))
    members = found.where("known").groupBy(F.col("a").alias("__m")).agg(F.min("b").alias("__root"))
    ids = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("__id")).join(members, F.col("__id") == F.col("__m"), "left")
    ids = ids.withColumn("__root", F.coalesce("__root", "__id")).join(classes.withColumnRenamed("id", "__node"), F.col("__root") == F.col("__node"), "left")
    label = F.coalesce("class_id", "__root")
    return ids.select(id_col, label.alias("class_id"), F.coalesce(label == F.col("__id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the members of a class that are not its first."""
    gone = near_duplicates(docs.select(id_col, text_col), id_col, text_col, **options).where("not kept").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
