"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is cut into vocabulary pieces so that the sum of their scores is largest
(integers, so sums do not depend on their order). Pieces never span certain
places, such as the one before a blank; between two such places lies a unit, and
a task solves each distinct unit of a batch once, many at a time.

A giant document is split into chunks that are solved apart. For each chunk a
transfer matrix says what it is worth to enter s characters behind its left edge
and to leave t characters behind its right edge (a piece may hang over by less
than the longest piece). Such matrices combine associatively by max-plus
products: first those of each block of chunks into one, then the blocks of a
document give the states at their edges, and these give the states at all edges
inside each block. Each chunk is then traced back independently between its two.

Among cuttings of the same worth the one with the longer last piece is taken (then
the longer one before it, and so on). Beside each matrix goes the order in which
its entries come under this rule, which combines associatively, too; so a document
gets the same pieces whether it is split or not.

A model of unigram type keeps its scores; other models (merges) get the logarithm
of a Zipf law over the rank. Characters outside the vocabulary become their UTF-8
bytes, and so does the mark that stands for a blank, so decoding is exact.

Defined results: a null or empty text has no pieces and decodes to the empty
text; a null id is carried through; repeated rows are encoded each; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .textkit import buffers, mix, ragged, slices, span_hashes

GIANT, CHUNK = 32_768, 8_192  # characters
BLOCK = 64  # chunks whose matrices are combined before those of the whole document are
BATCH = 1 << 20
IDS = 1 << 18  # ids decoded at once
MARK, LITERAL = 0x2581, 0x110000  # the blank's mark; a mark that the text itself has
NEVER = -(1 << 60)
_BASE = 0x9E3779B97F4A7C15
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Transfer:
    worth: np.ndarray  # [s, t]
    order: np.ndarray  # [s, t]: place of the entry s among those for t

    def packed(self) -> bytes:
        return self.worth.astype("<i8").tobytes() + self.order.astype(np.uint8).tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Transfer:
        side = int(round((len(raw) // 9) ** 0.5))
        return Transfer(np.frombuffer(raw, "<i8", side * side).reshape(side, side), np.frombuffer(raw, np.uint8, offset=8 * side * side).reshape(side, side).astype(np.int64))


class _Powers:
    up = down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n + 1, BATCH + 64), base, np.uint64)
            p[0] = 1
            setattr(_Powers, name, np.multiply.accumulate(p))
    return _Powers.up, _Powers.down


class Vocabulary:
    """Pieces by the fingerprint of their characters, with integer scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in ids]
        given = np.array([sp.get_score(i) for i in ids])
        if np.allclose(given, np.round(given)):  # ranks, not log-probabilities
            order = np.empty(len(ids), np.int64)
            order[np.argsort(-given, kind="stable")] = np.arange(len(ids))
            given = -np.log(order + 2.7) - np.log((1 / (np.arange(len(ids)) + 2.7)).sum())
        self.score = np.round(given * (1 << 16)).astype(np.int64)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.byte_score = int(self.score.min()) - (1 << 16)
        self.longest = max(map(len, texts))
        self.texts = dict(zip(ids, texts, strict=True))
        chars = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        keys = np.array([_fingerprint(c) for c in chars], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.score = keys[order], np.array(ids, np.int64)[order], self.score[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.joins = np.zeros(0x110002, bool)  # characters of longer pieces
        for c in chars:
            if len(c) > 1:
                self.joins[c] = True
        self.mark_starts = not any(a != MARK and b == MARK for c in chars for a, b in zip(c[:-1], c[1:]))
        out = [b""] * n
        for i, t in self.texts.items():
            out[i] = t.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        self.bytes_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    def edges(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and vocabulary place (-1: bytes, -2: none) of the pieces chars[start : start + size]."""
        up, down = _powers(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=sums[1:])
        key = mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
        score, place = np.full(len(starts), NEVER, np.int64), np.full(len(starts), -2, np.int64)
        maybe = np.flatnonzero(self.sieve[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[k] == key[maybe]
        place[maybe[hit]], score[maybe[hit]] = k[hit], self.score[k[hit]]
        lone = np.flatnonzero((sizes == 1) & (place < 0))
        c = chars[starts[lone]].astype(np.int64)
        c = np.where(c == LITERAL, MARK, c)
        place[lone], score[lone] = -1, self.byte_score * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        return score, place

    def cuts(self, chars: np.ndarray) -> np.ndarray:
        """Whether no piece can span the place before each character (and at the end)."""
        out = np.zeros(len(chars) + 1, bool)
        alone = ~self.joins[chars]
        out[:-1] |= alone
        out[1:] |= alone
        if self.mark_starts:
            out[1:-1] |= (chars[1:] == MARK) & (chars[:-1] != MARK)
        return out

    def solve(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of each span: ids of all spans one after the other, and how many each has."""
        size = ends - starts
        owners, ats, places = [], [], []
        for n in np.unique(size).tolist():
            who = np.flatnonzero(size == n)
            for part in np.array_split(who, max(1, len(who) * n // 32_768)):
                place, back = self._lattice(chars, starts[part], n)
                at, row = np.full(len(part), n), np.arange(len(part))
                while len(row):
                    step = back[row, at]
                    owners.append(part[row])
                    ats.append(at - step)
                    places.append(place[row, at, step - 1])
                    at = at - step
                    row, at = row[at > 0], at[at > 0]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        owner, at, place = map(np.concatenate, (owners, ats, places))
        order = np.lexsort((at, owner))
        owner, at, place = owner[order], at[order], place[order]
        ids = self.ids[np.maximum(place, 0)]
        lone = place < 0
        if lone.any():
            c = chars[(starts[owner] + at)[lone]]
            raw = [list(chr(MARK if x == LITERAL else x).encode("utf-8", "replace")) for x in c.tolist()]
            count = np.ones(len(ids), np.int64)
            count[lone] = [len(x) for x in raw]
            begin = np.cumsum(count) - count
            owner = np.repeat(owner, count)
            wide = np.repeat(ids, count)
            wide[ragged(begin[lone], count[lone])] = self.byte_ids[np.concatenate([np.array(x) for x in raw])]
            ids = wide
        return ids, np.bincount(owner, minlength=len(starts))

    def _lattice(self, chars: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For spans of one length: vocabulary place by (span, end, size), and the best last size by (span, end)."""
        most = min(n, self.longest)
        end, length = np.meshgrid(np.arange(n + 1), np.arange(1, most + 1), indexing="ij")
        valid = length <= end
        e, k = end[valid], length[valid]
        # the spans side by side, so that fingerprints cost what these spans hold
        own = chars[ragged(starts, np.full(len(starts), n))]
        at = (np.arange(len(starts)) * n)[:, None] + (e - k)[None, :]
        score, place = self.edges(own, at.ravel(), np.broadcast_to(k, at.shape).ravel())
        scores = np.full((len(starts), n + 1, most), NEVER, np.int64)
        places = np.full((len(starts), n + 1, most), -2, np.int64)
        scores[:, e, k - 1], places[:, e, k - 1] = score.reshape(at.shape), place.reshape(at.shape)
        best = np.full((len(starts), n + 1), NEVER, np.int64)
        best[:, 0] = 0
        back = np.zeros((len(starts), n + 1), np.int64)
        for i in range(1, n + 1):
            m = min(i, most)
            options = scores[:, i, :m] + best[:, i - m : i][:, ::-1]
            pick = m - 1 - options[:, ::-1].argmax(1)  # among equals the longest
            best[:, i], back[:, i] = options[np.arange(len(starts)), pick], pick + 1
        return places, back

    def encode(self, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts chars[at[d] : at[d + 1]] one after the other, and where each text's ids begin."""
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        cut = self.cuts(chars)
        cut[at] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        first, code = self._distinct(chars, starts, ends)
        flat, count = self.solve(chars, starts[first], ends[first])
        begin = np.cumsum(count) - count
        return flat[ragged(begin[code], count[code])], np.concatenate([[0], np.cumsum(count[code])])[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts with ids[at[d] : at[d + 1]] (each without its first blank), and offsets."""
        begin, size = self.bytes_at[ids], self.bytes_at[ids + 1] - self.bytes_at[ids]
        data = self.bytes[ragged(begin, size)]
        edge = np.concatenate([[0], np.cumsum(size)])[at]
        keep = np.ones(len(data), bool)
        keep[edge[:-1][np.diff(edge) > 0]] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[edge]

    def transfers(self, chars: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[Transfer]:
        """Max-plus matrices [s, t] of chunks: the size[d] characters of each, then those that a piece may hang over to."""
        most, none = self.longest, np.zeros(0, np.int64)
        cut = self.cuts(chars)
        cut[at[:-1]] = ~self.joins[chars[at[:-1]]]  # what stands before a chunk is not to be seen here
        cut[at[-1]] = False
        places = np.flatnonzero(cut)
        lo, end = np.searchsorted(places, at[:-1]), at[:-1] + size
        hi = np.where(end < at[1:], np.searchsorted(places, end, side="right"), np.searchsorted(places, end))
        # units between two cuts of one chunk, each distinct one solved once
        edge = np.zeros(len(places) + 1, np.int64)
        some = hi > lo
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, hi[some] - 1, -1)
        unit = np.flatnonzero(np.cumsum(edge[:-1]) > 0) if len(places) else none
        worth = np.zeros(len(places) + 1, np.int64)
        if len(unit):
            first, code = self._distinct(chars, places[unit], places[unit + 1])
            flat, count = self.solve(chars, places[unit][first], places[unit + 1][first])
            total = np.concatenate([[0], np.cumsum(self._scores()[flat])])
            stop = np.cumsum(count)
            worth[unit] = (total[stop] - total[stop - count])[code]
        before = np.concatenate([[0], np.cumsum(worth)])
        entries, out = np.arange(most), [None] * len(size)
        heads, tails = [None] * len(size), [None] * len(size)

        def fill(target: list, who: np.ndarray, starts: np.ndarray, n: np.ndarray, total: np.ndarray, entries: np.ndarray) -> None:
            for key in np.unique(np.stack([n, total], 1), axis=0):
                same = np.flatnonzero((n == key[0]) & (total == key[1]))
                for part in np.array_split(same, -(-len(same) * int(key[1] + 1) * most // (1 << 21))):
                    for d, x in zip(who[part].tolist(), zip(*self._worth(chars, starts[part], int(key[0]), int(key[1]), entries), strict=True), strict=True):
                        target[d] = x

        reach = np.minimum(np.diff(at), size + most - 1)
        who = np.flatnonzero(some)
        a, b = (places[lo[who]], places[hi[who] - 1]) if len(who) else (none, none)
        fill(heads, who, at[who], a - at[who], a - at[who], entries)
        fill(tails, who, b, end[who] - b, at[who] + reach[who] - b, entries[:1])
        for d in who.tolist():
            head, rank = heads[d][0][:, 0], heads[d][1][:, 0]
            tail = tails[d][0][0]
            m = head[:, None] + (before[hi[d] - 1] - before[lo[d]]) + tail[None, :]
            m = np.where((head[:, None] <= NEVER // 2) | (tail[None, :] <= NEVER // 2), NEVER, m)
            out[d] = Transfer(m, np.repeat(rank[:, None], most, 1))
        who = np.flatnonzero(~some)
        fill(out, who, at[who], size[who], reach[who], entries)
        return [x if isinstance(x, Transfer) else Transfer(*x) for x in out]

    def _distinct(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct span stands first, and the number of the distinct span that each span is."""
        keys = span_hashes(np.ascontiguousarray(chars).view(np.uint8), starts * 4, ends * 4)
        _, first, code = np.unique(keys, return_index=True, return_inverse=True)
        return first, code

    def _scores(self) -> np.ndarray:
        if not hasattr(self, "_by_id"):
            self._by_id = np.full(len(self.bytes_at) - 1, self.byte_score, np.int64)
            self._by_id[self.ids] = self.score
        return self._by_id

    def _worth(self, chars: np.ndarray, starts: np.ndarray, n: int, total: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of spans of `total` characters: best scores [span, entry, t] from each entry to place n + t, where the last piece
        begins before n (or there is none), and the order of the entries for each t."""
        most, e, rows = self.longest, len(entries), np.arange(len(starts))
        end, size = np.repeat(np.arange(1, total + 1), most), np.tile(np.arange(1, most + 1), total)
        ok = (size <= end) & (end - size < n)
        end, size = end[ok], size[ok]
        score = np.full((len(starts), total, most), NEVER, np.int64)
        if len(end):
            own = chars[ragged(starts, np.full(len(starts), total))]
            at = (rows * total)[:, None] + (end - size)[None, :]
            score[:, end - 1, size - 1] = self.edges(own, at.ravel(), np.broadcast_to(size, at.shape).ravel())[0].reshape(at.shape)
        best = np.full((len(starts), total + 1, e), NEVER, np.int64)
        order = np.zeros((len(starts), total + 1, e), np.int64)
        for i in range(total + 1):
            key = np.full((len(starts), e), 1 << 20, np.int64)
            if i:
                m = min(i, most)
                options = score[:, i - 1, :m, None] + best[:, i - m : i][:, ::-1]
                pick = m - 1 - options[:, ::-1].argmax(1)  # among equals the longest
                best[:, i] = np.maximum(np.take_along_axis(options, pick[:, None], 1)[:, 0], NEVER)
                if e > 1:
                    key = np.where(best[:, i] > NEVER // 2, (most - pick) * 64 + order[rows[:, None], i - 1 - pick, np.arange(e)], key)
            if i < most and (entries == i).any():
                j = int(np.flatnonzero(entries == i)[0])
                best[:, i, j], key[:, j] = 0, -1  # a path that begins here came over the edge by a longer piece
            if e > 1:
                order[:, i] = key.argsort(1, kind="stable").argsort(1, kind="stable")
        worth, ranks = np.full((len(starts), e, most), NEVER, np.int64), np.zeros((len(starts), e, most), np.int64)
        upto = min(most, total - n + 1)
        worth[:, :, :upto] = best[:, n : n + upto].transpose(0, 2, 1)
        ranks[:, :, :upto] = order[:, n : n + upto].transpose(0, 2, 1)
        return np.where(worth > NEVER // 2, worth, NEVER), ranks


def _fingerprint(chars: np.ndarray) -> np.uint64:
    up, _ = _powers(len(chars))
    with np.errstate(over="ignore"):
        total = (mix(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)]).sum(dtype=np.uint64)
        return mix(np.array([total + np.uint64(len(chars))]))[0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def characters(column: pa.Array, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts with blanks as marks, and offsets; where prefix says so a mark stands in front."""
    data, offsets = buffers(column)
    at = np.concatenate([[0], np.cumsum(_HEAD[data])])[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.where(chars == MARK, np.uint32(LITERAL), np.where(chars == 32, np.uint32(MARK), chars)).astype(np.uint32)
    ahead = np.diff(at) > 0 if prefix is None else prefix & (np.diff(at) > 0)
    return np.insert(chars, at[:-1][ahead], MARK).astype(np.uint32), at + np.concatenate([[0], np.cumsum(ahead)])


def combine(a: Transfer, b: Transfer) -> Transfer:
    """Max-plus product, and the order of the entries: that of the middle states, then that of the entries to them."""
    options = a.worth[:, :, None] + b.worth[None, :, :]
    worth = options.max(1)
    middle = np.where(options == worth[:, None, :], b.order[None, :, :], 1 << 20).argmin(1)  # [s, u]
    key = np.take_along_axis(b.order, middle, 0) * 64 + np.take_along_axis(a.order, middle, 1)
    key = np.where(worth > NEVER // 2, key, 1 << 20)
    return Transfer(np.where(worth > NEVER // 2, worth, NEVER), key.argsort(0, kind="stable").argsort(0, kind="stable"))


def edge_states(transfers: list[Transfer], enter: int = 0, leave: int = 0) -> list[int]:
    """States at all edges of the best path from one state to another."""
    ahead = np.full(len(transfers[0].worth), NEVER, np.int64)
    ahead[enter] = 0
    prefixes = [ahead]
    for x in transfers[:-1]:
        ahead = np.maximum((ahead[:, None] + x.worth).max(0), NEVER)
        prefixes.append(ahead)
    states = [leave]
    for x, p in zip(transfers[::-1], prefixes[::-1], strict=True):
        total = p + x.worth[:, states[-1]]
        states.append(int(np.where(total == total.max(), x.order[:, states[-1]], 1 << 20).argmin()))
    return states[::-1]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(id, ids): the pieces of every text."""
    path = model or default_model()
    frame = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kind = frame.schema[0].dataType.simpleString()

    def whole(batches):
        for batch in slices(batches, "__text", BATCH):
            ids, at = vocabulary(path).encode(*characters(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))], names=[id_col, "ids"])

    def split(batches):
        over = vocabulary(path).longest - 1
        for batch in slices(batches, "__text", BATCH):
            for i, text in enumerate(batch.column("__text").to_pylist()):
                for at in range(0, len(text), BATCH // 2):
                    rows = [(a // chunk, text[a : a + chunk + over], min(chunk, len(text) - a), a + chunk >= len(text)) for a in range(-(-at // chunk) * chunk, min(at + BATCH // 2, len(text)), chunk)]
                    if rows:
                        same = pa.array([i] * len(rows), pa.int64())
                        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column("__row").take(same), *columns], names=["__id", "row", "part", "text", "size", "last"])

    giants = frame.where(F.length("__text") > giant).withColumn("__row", F.monotonically_increasing_id())
    chunks = giants.mapInArrow(split, f"__id {kind}, row long, part int, text string, size int, last boolean")
    chunks = checkpointed(chunks.repartition("row", "part"))

    def matrices(batches):
        for batch in slices(batches, "text", BATCH):
            first, last = batch.column("part").to_numpy() == 0, batch.column("last").to_numpy(zero_copy_only=False)
            out = vocabulary(path).transfers(*characters(batch.column("text"), first), batch.column("size").to_numpy().astype(np.int64) + first)
            for d in np.flatnonzero(last).tolist():
                out[d].worth[:, 1:] = NEVER
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(batch.column("part").to_numpy() // BLOCK), pa.array([x.packed() for x in out], pa.binary())], names=["row", "part", "block", "m"])

    def ordered(table: pa.Table, by: str) -> tuple[np.ndarray, list[Transfer]]:
        order = np.argsort(table[by].to_numpy())
        raw = table["m"].to_pylist()
        return table[by].to_numpy()[order], [Transfer.unpacked(raw[i]) for i in order]

    def fold(table: pa.Table) -> pa.Table:
        """The product of a block's matrices."""
        return pa.table({"row": table["row"][:1], "block": table["block"][:1], "m": pa.array([reduce(combine, ordered(table, "part")[1]).packed()], pa.binary())})

    def across(table: pa.Table) -> pa.Table:
        """States at the edges of a document's blocks, of which a text of 2 GB has 4096."""
        blocks, transfers = ordered(table, "block")
        states = np.array(edge_states(transfers), np.int32)
        return pa.table({"row": table["row"], "block": pa.array(blocks), "enter": pa.array(states[:-1]), "leave": pa.array(states[1:])})

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, transfers = ordered(left, "part")
        states = np.array(edge_states(transfers, right["enter"][0].as_py(), right["leave"][0].as_py()), np.int32)
        return pa.table({"row": left["row"], "part": pa.array(parts), "s": pa.array(states[:-1]), "t": pa.array(states[1:])})

    def trace(batches):
        for batch in slices(batches, "text", BATCH):
            part = batch.column("part").to_numpy()
            chars, at = characters(batch.column("text"), part == 0)
            size = batch.column("size").to_numpy() + (part == 0)
            a, b = at[:-1] + batch.column("s").to_numpy(), at[:-1] + size + batch.column("t").to_numpy()
            own = np.maximum(b - a, 0)
            ids, edge = vocabulary(path).encode(chars[ragged(a, own)], np.concatenate([[0], np.cumsum(own)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "__id", "part")), pa.ListArray.from_arrays(edge.astype(np.int32), ids.astype(np.int32))], names=["row", "__id", "part", "ids"])

    made = checkpointed(chunks.select("row", "part", "text", "size", "last").mapInArrow(matrices, "row long, part int, block int, m binary"))
    blocks = made.groupBy("row", "block").applyInArrow(fold, "row long, block int, m binary")
    edges = blocks.groupBy("row").applyInArrow(across, "row long, block int, enter int, leave int")
    states = made.groupBy("row", "block").cogroup(edges.groupBy("row", "block")).applyInArrow(within, "row long, part int, s int, t int")
    traced = chunks.join(states, ["row", "part"]).mapInArrow(trace, f"row long, __id {kind}, part int, ids array<int>")
    joined = traced.groupBy("row").agg(F.first("__id").alias(id_col), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return frame.where(F.length("__text") <= giant).mapInArrow(whole, f"`{id_col}` {kind}, ids array<int>").unionByName(joined.select(id_col, "ids"))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, model: str | None = None) -> DataFrame:
    """(id, ids, text) from the pieces."""
    path = model or default_model()
    frame = encoded.select(F.col(id_col), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in slices(batches, "ids", IDS):
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            data, edge = vocabulary(path).decode(ids.flatten().to_numpy().astype(np.int64), at - at[0])
            text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, text.cast(pa.string())], names=[id_col, "ids", "text"])

    return frame.mapInArrow(run, f"`{id_col}` {frame.schema[0].dataType.simpleString()}, ids array<int>, text string")
