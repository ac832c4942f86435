"""Best-fit packing of tokenised documents into training sequences by exact complements.

Only the counts of pieces per length decide which lengths share a sequence, and
there are at most `capacity` lengths. So the plan is made from that small
histogram: for each length, the gap it leaves is looked up among single lengths,
sums of two and sums of three, and combinations that fill it exactly are used as
often as the counts allow; what is left goes to the fullest open sequence that
takes it. The plan says which ranks of each length go where, and a join with it
places every piece, however many there are.

Defined results: a null text is an empty one (only the end token); a null id is
carried through; repeated rows are packed once each; pieces of equal length are
interchangeable, so ties only decide which of them goes where; a text of any length
is tokenised whole and cut; an empty table gives no rows; only id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed
from .textkit import buffers, ragged, slices, span_hashes, spread

CAPACITY = 1024
END = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder for a byte-level BPE file: each byte string's rank is its id."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[tuple[bytes, int], ...]:
    """Texts that are one token wherever they stand; what is before and behind them is encoded apart."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("added tokens that depend on what is around them")
    return tuple((t["content"].encode(), t["id"]) for t in found)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    ranks = encoder(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        out[i] = len(token)
    return out


def _plain(x: np.ndarray) -> np.ndarray:
    return (x > 32) & (x < 127)


def _pieces_apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the tokenizer treats independently: cut before a lone blank and around a lone line feed."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        plain = _plain(data)
        before = np.zeros(n, bool)
        before[1:] = plain[:-1]
        before[2:] |= (data[1:-1] >= 128) & (data[:-2] == 0xC3)  # a Latin letter of two bytes
        after = np.zeros(n, bool)
        after[:-1] = plain[1:] | (data[1:] == 0xC3)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        lone = before & after & ~first[:-1] & ~first[1:]
        cut[:-1] |= lone & ((data == 32) | (data == 10))
        cut[1:] |= lone & (data == 10)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's ids begin."""
    raw, special = data.tobytes(), []
    for content, i in added_tokens(path):
        at = raw.find(content)
        while at >= 0:
            whole = np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(content))
            if whole:  # not across two texts
                special.append((at, at + len(content), i))
            at = raw.find(content, at + (len(content) if whole else 1))
    if not special:
        return _ordinary_ids(data, offsets, path)
    special.sort()
    edges = np.array([e for x in special for e in x[:2]])
    parts = np.unique(np.concatenate([offsets, edges]))  # every part a text of its own
    apart = np.zeros(len(data), bool)
    for a, b, _ in special:
        apart[a:b] = True
    ids, at = _ordinary_ids(data[~apart], parts - np.concatenate([[0], np.cumsum(apart)])[parts], path)
    begin = at[np.searchsorted(parts, [a for a, _, _ in special])]
    ids = np.insert(ids, begin, np.array([i for _, _, i in special], ids.dtype))
    return ids, at[np.searchsorted(parts, offsets)] + np.searchsorted([b for _, b, _ in special], offsets, side="right")


def _ordinary_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = _pieces_apart(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    code, _ = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    begins, stops = starts[first], ends[first]
    enc = encoder(path)
    sizes = np.zeros(len(first), np.int64)
    # a blank and a plain character in front, a plain one at the end: such spans stay apart when joined, so one call takes them all
    second, last, ahead = data[np.minimum(begins + 1, len(data) - 1)], data[stops - 1], data[stops - 2]
    joined = (stops - begins > 1) & (data[begins] == 32) & (_plain(second) | (second == 0xC3)) & (_plain(last) | ((last >= 128) & (ahead == 0xC3)))
    text = data[ragged(begins[joined], (stops - begins)[joined])].tobytes().decode("utf-8")
    together = np.array(enc.encode_ordinary(text), np.uint32)
    upto = np.searchsorted(np.cumsum(_token_bytes(path)[together]), np.cumsum((stops - begins)[joined])) + 1 if len(together) else np.zeros(0, np.int64)
    sizes[joined] = np.diff(upto, prepend=0)
    raw, flat = data.tobytes(), []
    for i in np.flatnonzero(~joined).tolist():
        ids = enc.encode_ordinary(raw[begins[i] : stops[i]].decode("utf-8", "replace"))
        flat.extend(ids)
        sizes[i] = len(ids)
    where = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
    begin = np.empty(len(first), np.int64)
    begin[where] = np.cumsum(sizes[where]) - sizes[where]
    ids = np.concatenate([together, np.array(flat, np.uint32)])[ragged(begin[code], sizes[code])]
    upto = np.concatenate([[0], np.cumsum(sizes[code])])
    return ids, upto[np.searchsorted(starts, offsets)]


_PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: id, piece, start, length, ids_crc32 (and ids).

    Only documents of more than `capacity` ids are cut; the first piece takes the remainder.
    """
    path = tokenizer or default_tokenizer()
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = frame.schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "__text"):
            ids, at = token_ids(*buffers(batch.column("__text")), path)
            rows, piece, start, length, crc, tokens = [], [], [], [], [], []
            for d in range(batch.num_rows):
                own = np.append(ids[at[d] : at[d + 1]], np.uint32(end)).astype("<u4")
                edge = len(own) % capacity
                edges = [0] * bool(edge or not len(own)) + list(range(edge, len(own) + 1, capacity)) if len(own) > capacity else [0, len(own)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    if with_ids:
                        tokens.append(own[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return frame.mapInArrow(run, f"`{id_col}` {kind}, {_PIECES}" + ", ids array<int>" * with_ids)


#: Share of the capacity from which a beginning is filled exactly, and whether short beginnings come first.
FILLED = ((Fraction(1, 3), True), (Fraction(7, 8), False), (Fraction(2, 3), False), (Fraction(5, 6), True))
Plan = list[tuple[tuple[int, ...], int]]  # lengths that share a sequence, and how many such sequences there are


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Which lengths share a sequence: of several plans the one with the fewest sequences.

    All of them fill gaps exactly by one, two or three pieces where counts allow, and only the rest by best fit. They
    differ in which sequences are filled so: those begun by a third of the capacity or more, or only by longer pieces,
    whose gaps are small; what is spared of the short pieces keeps the others fillable. And in whether the gaps of short
    or of long beginnings are filled first.
    """
    least = -(-sum(n * k for n, k in counts.items()) // capacity)
    best, fewest = [], None
    for share, upward in FILLED:
        made = _plan(counts, capacity, -(-capacity * share.numerator // share.denominator), upward)
        used = sum(times for _, times in made)
        if fewest is None or used < fewest:
            best, fewest = made, used
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, begun: int, upward: bool) -> Plan:
    """Exact fills by up to three pieces of sequences begun by lengths from `begun` on, then best fit."""
    c = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        c[n] += k
    made: Plan = []

    def use(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(int(c[n]) // k for n, k in need.items())
        if times > 0:
            made.append((lengths, times))
            for n, k in need.items():
                c[n] -= k * times

    def pairs(total: int, largest: int) -> np.ndarray:
        """The larger lengths of the pairs at hand with this sum, largest first."""
        a = np.arange((total + 1) // 2, min(total - 1, largest) + 1)
        return a[(c[a] > 0) & (c[total - a] > 0)][::-1]

    def fill(big: int, gap: int, others: int) -> None:
        """As often as the counts allow: big and that many others that take the gap exactly, the largest ones first."""
        if others == 1 and gap <= big:
            use(big, gap)
        for a in pairs(gap, big).tolist() if others == 2 else ():
            if c[big]:
                use(big, a, gap - a)
        for a in (np.flatnonzero(c[1 : min(gap - 2, big) + 1]) + 1)[::-1].tolist() if others == 3 else ():
            for b in pairs(gap - a, a).tolist() if c[a] else ():
                if c[big] and c[a]:
                    use(big, a, b, gap - a - b)
            if not c[big]:
                break

    use(capacity)
    for others in (1, 2, 3):  # fills by fewer pieces first: they spare the small ones
        for big in range(begun, capacity) if upward else range(capacity - 1, begun - 1, -1):
            if c[big]:
                fill(big, capacity - big, others)
    open_at: dict[int, Plan] = {}  # by room left
    for n in range(capacity, 0, -1):
        left = int(c[n])
        while left:
            room = next((r for r in range(n, capacity) if open_at.get(r)), 0)
            if room:
                lengths, times = open_at[room].pop()
                took = min(times, left)
                if took < times:
                    open_at[room].append((lengths, times - took))
                open_at.setdefault(room - n, []).append((lengths + (n,), took))
                left -= took
            else:
                each = min(capacity // n, left)
                took = left // each
                open_at.setdefault(capacity - each * n, []).append(((n,) * each, took))
                left -= each * took
    return made + [x for r in sorted(open_at) for x in open_at[r]]


def place(rows: DataFrame, id_col: str = "doc_id", *, capacity: int = CAPACITY) -> DataFrame:
    """rows (id, piece, start, length, ...) with sequence_id and offset. rows are read several times."""
    spark = rows.sparkSession
    slots, taken, base = [], Counter(), 0
    for lengths, times in plan({r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}, capacity):
        at = 0
        for n in lengths:
            slots.append((n, taken[n], times, base, at))
            taken[n] += times
            at += n
        base += times
    # one array per figure, ordered by length and first rank; bounded by the capacity, not by the rows
    length, lo, _, base_of, offset_of = np.array(sorted(slots), np.int64).reshape(-1, 5).T
    held, names = spark.sparkContext.broadcast((length, lo, base_of, offset_of)), rows.columns

    def locate(batches):
        length, lo, base_of, offset_of = held.value
        first, stop = (np.searchsorted(length, np.arange(capacity + 1), side=s) for s in ("left", "right"))
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            slot = np.empty(len(n), np.int64)
            for each in np.unique(n).tolist():
                x = np.flatnonzero(n == each)
                slot[x] = first[each] + np.searchsorted(lo[first[each] : stop[each]], rank[x], side="right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base_of[slot] + rank - lo[slot]), pa.array(offset_of[slot])], names=[*names, "sequence_id", "offset"])

    # ranks within a length without bringing a common length into one task: by salt, then shifted
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(spread(spark, 1))))
    shift = salted.groupBy("length", "__salt").count().select("length", "__salt", (F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__shift"))
    ranked = salted.withColumn("__in", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(id_col, "piece")) - 1)
    ranked = ranked.join(shift, ["length", "__salt"]).withColumn("__rank", F.col("__in") + F.col("__shift"))
    kinds = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(locate, kinds)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(checkpointed(pieces(docs, id_col, text_col, capacity=capacity, end=end, tokenizer=tokenizer, with_ids=with_ids)), id_col, capacity=capacity)
