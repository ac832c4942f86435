"""Language-model scores of whole documents, beside a smoothed unigram base.

The model reads a text as words. Each word begins with a subword of a public
vocabulary (its longest prefix there), and a causal self-attention model over
these subword ids predicts the next one, by a two-level softmax over groups and their
members: the 2046 most frequent ids have a class each, the rest share one. Within a class a word has the probability that the
corpus counts give it, mixed with a spelling model (bytes given the three before)
that also covers words never seen. Windows of 48 words overlap by 16, so each
word and the end is scored once, with 16 to 47 words in view.

Learning covers all training rows: id, spelling and word counts are sums over the
corpus; attention weights are trained on all windows of all training texts. The texts
are dealt by a hash to shards of about SHARD bytes; each shard takes one pass from the
same start, and the weights of the shards are averaged by two exchanges. So neither
the partitions of the input nor those of a shuffle decide what is learned.

Word counts are looked up by groups of documents ("homes"): each home sends the
fingerprints of its distinct words to buckets, which add them up and answer with
the counts. A common word is one entry per home, however often it occurs.

Defined results: a null or empty text is only its end; rows without an id are
scored and are not learned from; repeated rows are learned from and scored each;
an empty table gives no rows; with no training rows the base counts are zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .packing import default_tokenizer, encoder
from .textkit import Words, buffers, distinct, pack, ragged, slices, spread, sum_by, unpack

INPUTS, CLASSES = 4096, attention.GROUPS * attention.MEMBERS  # ids with an embedding of their own; classes to predict
SHARD = 32 << 20  # bytes of training text that one model sees before the models are averaged
_LONGEST = 8
_CONTEXTS = (16384, 4096, 256, 1)  # rows of the spelling tables: powers of two
_BACK = 10.0  # weight of the shorter context
_END = np.uint64(0xE0DE0DE0DE0DE0D1)
_REGISTERS, _RANKS = 64, 59  # of the distinct-word sketch of each class, and how many leading zeros a 58-bit rest can have, plus one


@lru_cache(maxsize=2)
def leading(path: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Subwords that can begin a word, by their size: their bytes as one number (ascending) and ids; and the number of ids."""
    tokens = sorted({t[1:].lower() for t in encoder(path)._mergeable_ranks if t[:1] == b" " and 0 < len(t[1:].strip()) <= _LONGEST and b" " not in t[1:]} | {bytes([b]) for b in range(33, 256)} | {bytes([b]) for b in range(9)} | {bytes([b]) for b in range(14, 32)})
    out = []
    for n in range(1, _LONGEST + 1):
        ids = np.array([i for i, t in enumerate(tokens) if len(t) == n], np.int64)
        values = np.array([int.from_bytes(tokens[i], "little") for i in ids], np.uint64)
        order = np.argsort(values)
        out.append((values[order], ids[order]))
    return out, len(tokens)


class Vocabulary:
    """The distinct words of a batch of texts."""

    def __init__(self, column: pa.Array, path: str):
        data, offsets = buffers(column)
        self.words = w = Words(data, offsets)
        self.keys, first, self.code = distinct(w.hashes(lower=True))
        size = (w.ends - w.starts)[first]
        self.size, self.stop = size, np.cumsum(size)
        self.start = self.stop - size
        self.bytes = data[ragged(w.starts[first], size)]
        low = (self.bytes >= 65) & (self.bytes <= 90)
        self.bytes = np.where(low, self.bytes + 32, self.bytes).astype(np.uint8)
        table, _ = leading(path)
        padded = np.zeros(len(self.bytes) + 8, np.uint8)
        padded[: len(self.bytes)] = self.bytes
        eight = np.ndarray((len(self.bytes) + 1,), "<u8", padded, strides=(1,))[self.start]
        self.ids, self.lead = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        left = np.arange(len(size))
        for n in range(_LONGEST, 0, -1):
            values, ids = table[n - 1]
            if len(values):
                x = left[size[left] >= n]
                own = eight[x] & np.uint64((1 << 8 * n) - 1)
                k = np.minimum(np.searchsorted(values, own), len(values) - 1)
                hit = values[k] == own
                self.ids[x[hit]], self.lead[x[hit]] = ids[k[hit]], n
                left = left[self.lead[left] == 0]

    def texts_with(self) -> np.ndarray:
        """In how many of the texts each word occurs."""
        own = pd.unique(self.words.docs() * np.int64(max(len(self.keys), 1)) + self.code)
        return np.bincount(own % max(len(self.keys), 1), minlength=len(self.keys))

    def spelling(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each byte behind the leading subword, and for the word's end: cells of the spelling tables (given three, two
        and one bytes before, and none), and the word's number."""
        n = self.size - self.lead + 1
        word = np.repeat(np.arange(len(n)), n)
        at = ragged(self.start + self.lead, n)
        end = at == self.stop[word]
        byte = np.where(end, 32, self.bytes[np.minimum(at, max(len(self.bytes) - 1, 0))] if len(self.bytes) else 32).astype(np.int64)

        def before(k: int) -> np.ndarray:
            p = at - k
            return np.where(p >= self.start[word], self.bytes[np.maximum(p, 0)] if len(self.bytes) else 0, 0).astype(np.int64)

        one, two, three = before(1), before(2), before(3)
        return [c * 256 + byte for c in ((three * 5077 + two * 67 + one * 3) & (_CONTEXTS[0] - 1), (two * 67 + one * 3) & (_CONTEXTS[1] - 1), one, np.zeros_like(one))], word


@dataclass
class Model:
    path: str
    rank: np.ndarray  # id -> input row (0: start of text)
    classes: np.ndarray  # id -> class
    end: int  # class of the end
    within: np.ndarray  # id -> natural log of its share in its class
    totals: np.ndarray  # tokens per class
    spell: list[np.ndarray]  # counts of the spelling tables
    seen: list[np.ndarray]  # their row sums
    novel: np.ndarray  # per class, the share of words never seen before
    weights: dict[str, np.ndarray]

    def sequences(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and target classes of all texts (each begins with the start and ends with the end)."""
        counts = v.words.counts
        length = counts + 1
        begin = np.cumsum(length) - length
        ids = v.ids[v.code]
        doc = v.words.docs()
        at = np.arange(len(ids)) + doc
        inputs, targets = np.zeros(int(length.sum()), np.int64), np.full(int(length.sum()), self.end, np.int64)
        inputs[at + 1] = self.rank[ids]
        targets[at] = self.classes[ids]
        return inputs, targets, begin, length

    def word_logs(self, v: Vocabulary, counts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each distinct word given its class; counts: its corpus count."""
        cells, word = v.spelling()
        p = np.full(len(word), 1 / 256)
        for cell, counts_of, rows in zip(cells[::-1], self.spell[::-1], self.seen[::-1], strict=True):
            p = (counts_of[cell] + _BACK * p) / (rows[cell >> 8] + _BACK)
        spelled = self.within[v.ids] + sum_by(word, np.log(p), len(v.keys))
        total, new = np.maximum(self.totals[self.classes[v.ids]], 1), self.novel[self.classes[v.ids]]
        return np.logaddexp(np.log(np.maximum((1 - new) * counts / total, 1e-300)), np.log(new) + spelled)


def _read(docs: DataFrame, id_col: str, text_col: str, training) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), (F.coalesce(training, F.lit(False)) & F.col(id_col).isNotNull()).alias("__train"))


_PART = "shard long, n double, p binary, s binary"


def _average(rows: DataFrame, shards: int, shape: dict[str, tuple]) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Mean of packed parameters, by weight, and union of sketches: first of about the root of the shards each, then of these."""

    def mean(table: pa.Table) -> pa.Table:
        total, weight, sketch = 0.0, 0.0, None
        for i in np.argsort(table["shard"].to_numpy()).tolist():  # the same sum in whatever order they come
            n, p, s = table["n"][i].as_py(), table["p"][i].as_buffer(), table["s"][i].as_buffer()
            total, weight, s = total + np.frombuffer(p, np.float32).astype(np.float64) * n, weight + n, np.frombuffer(s, np.uint8)
            sketch = s if sketch is None else np.maximum(sketch, s)
        return _part(table["shard"][0].as_py() // group, weight, total / weight, sketch)

    group = max(1, round(shards**0.5))
    some = rows.withColumn("some", F.floor(F.col("shard") / group)).groupBy("some").applyInArrow(mean, _PART)
    few = some.withColumn("some", F.lit(0)).groupBy("some").applyInArrow(mean, _PART).collect()
    if not few:
        return None
    flat, out, at = np.frombuffer(few[0]["p"], np.float32), {}, 0
    for k, s in shape.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).copy()
        at += int(np.prod(s))
    return out, np.frombuffer(few[0]["s"], np.uint8).reshape(CLASSES, _REGISTERS)


def _part(shard: int, n: float, p: np.ndarray, sketch: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": [float(n)], "p": pa.array([p.astype(np.float32).tobytes()], pa.binary()), "s": pa.array([sketch.tobytes()], pa.binary())})


def _novelty(sketch: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per class d / (n + d) with n words and about d distinct ones (Witten and Bell), d by the sketch."""
    m = sketch.shape[1]
    d = 0.7213 / (1 + 1.079 / m) * m * m / (2.0 ** -sketch.astype(float)).sum(1)
    empty = (sketch == 0).sum(1)
    d = np.where((d < 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), d)
    return np.clip(d / np.maximum(totals + d, 1), 1e-4, 0.6)


def fit(read: DataFrame, path: str, shard: int = SHARD) -> Model:
    """The model of the training rows of `read` (__id, __text, __train)."""
    n_ids = leading(path)[1]
    known = read.where("__train").select("__id", "__text")

    def statistics(batches):
        ids, texts = np.zeros(n_ids, np.int64), np.zeros(2, np.int64)  # number and bytes
        cells = [np.zeros(c * 256, np.int64) for c in _CONTEXTS]
        for batch in slices(batches, "__text"):
            v = Vocabulary(batch.column("__text"), path)
            ids += np.bincount(v.ids[v.code], minlength=n_ids)
            at, word = v.spelling()
            texts_with = v.texts_with()[word]  # a word counts once a text: neither as often as it is said, nor once a batch
            for total, cell in zip(cells, at, strict=True):
                np.add.at(total, cell, texts_with)
            texts += (batch.num_rows, len(v.words.data))
        for kind, x in enumerate((ids, texts, *cells)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["kind", "at", "n"])

    sums = known.mapInArrow(statistics, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()  # bounded by the tables' sizes

    def dense(kind: int, size: int) -> np.ndarray:
        x, part = np.zeros(size, np.int64), sums[sums["kind"] == kind]
        x[part["at"].to_numpy()] = part["n"].to_numpy()
        return x

    ids, (texts, size) = dense(0, n_ids), dense(1, 2)
    spell = [dense(2 + i, c * 256).astype(np.float32) for i, c in enumerate(_CONTEXTS)]
    seen = [x.reshape(-1, 256).sum(1) for x in spell]
    order = np.argsort(-ids, kind="stable")
    rank, classes = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int64)
    rank[order] = np.minimum(np.arange(n_ids) + 1, INPUTS - 1)
    # classes by falling counts, so that a group has members of like weight: the most frequent ids, all others, the end
    classes[order] = np.minimum(np.arange(n_ids), CLASSES - 2)
    weight = np.append(np.bincount(classes, ids, CLASSES - 1), texts)
    number = np.empty(CLASSES, np.int64)
    number[np.argsort(-weight, kind="stable")] = np.arange(CLASSES)
    classes, end = number[classes], int(number[-1])
    totals = np.zeros(CLASSES)
    totals[number] = weight
    members = np.bincount(classes, minlength=CLASSES)
    within = np.log((ids + 0.5) / (totals[classes] + 0.5 * members[classes]))
    model = Model(path, rank, classes, end, within, totals, spell, seen, np.full(CLASSES, 0.1), attention.initial(INPUTS, totals))
    shape = {k: v.shape for k, v in model.weights.items()}
    shards = max(1, -(-int(size) // shard))

    def local(table: pa.Table) -> pa.Table:
        training, sketch = attention.Training(model.weights), np.zeros((CLASSES, _REGISTERS), np.uint8)
        key = table["key"].to_numpy()
        for batch in slices(table.take(pa.array(np.argsort(key, kind="stable"))).to_batches(), "__text", 2 << 20):
            v = Vocabulary(batch.column("__text"), path)
            x, y, begin, length = model.sequences(v)
            rest = (v.keys // np.uint64(_REGISTERS)).astype(np.float64)
            np.maximum.at(sketch, (model.classes[v.ids], (v.keys % np.uint64(_REGISTERS)).astype(np.int64)), np.maximum(_RANKS - np.floor(np.log2(rest + 1)), 1).astype(np.uint8))
            training.windows(x, y, begin, length)
        return _part(table["shard"][0].as_py(), training.seen, np.concatenate([training.p[k].ravel() for k in shape]), sketch)

    dealt = known.withColumn("key", F.xxhash64("__id", "__text")).select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "__text")
    model.weights, sketch = _average(dealt.groupBy("shard").applyInArrow(local, _PART), shards, shape) or (model.weights, np.zeros((CLASSES, _REGISTERS), np.uint8))
    model.novel = _novelty(sketch, totals)
    return model


_SENT = "bucket int, home int, keys binary, counts binary, tokens long, distinct long"


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = [("bucket", pa.int32()), ("home", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row. training: condition on the rows to learn from."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    buckets, homes = spread(spark, 1), spread(spark, 2)
    read = _read(docs, id_col, text_col, training)
    kind = read.schema[0].dataType.simpleString()
    model = spark.sparkContext.broadcast(fit(read, path))  # bounded by INPUTS, CLASSES and the spelling table
    homed = read.withColumn("home", F.pmod(F.xxhash64("__id", "__text"), F.lit(homes)).cast("int")).select("home", "__id", "__text", "__train").groupBy("home")

    def ask(table: pa.Table) -> pa.Table:
        """Distinct words of the home with their counts in its training texts; the end is one of them."""
        home, keys, counts = table["home"][0].as_py(), [np.array([_END])], [np.array([pc.sum(table["__train"]).as_py() or 0])]
        for batch in slices(table.to_batches(), "__text", 4 << 20):
            w = Words(*buffers(batch.column("__text")))
            k, _, code = distinct(w.hashes(lower=True))
            keys.append(k)
            counts.append(np.bincount(code, np.repeat(batch.column("__train").to_numpy(zero_copy_only=False), w.counts), len(k)).astype(np.int64))
        keys, code = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(code, np.concatenate(counts), len(keys)).astype(np.int64)
        part = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1))
        return _sent([(int(part[order[i]]), home, pack(keys[order[i:j]]), pack(counts[order[i:j]].astype(np.uint32)), 0, 0) for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True)])

    def answer(table: pa.Table) -> pa.Table:
        """Corpus counts for each home that asked; home -1: tokens and distinct words of this bucket."""
        keys, counts = unpack(table["keys"], np.uint64), unpack(table["counts"], np.uint32).astype(np.int64)
        own, code = np.unique(keys, return_inverse=True)
        sums = np.bincount(code, counts, len(own)).astype(np.int64)
        rows, at = [(0, -1, b"", b"", int(sums.sum()), int((sums > 0).sum()))], 0
        for home, k in zip(table["home"].to_pylist(), table["keys"].to_pylist(), strict=True):
            n = len(k) // 8
            rows.append((0, home, k, pack(sums[code[at : at + n]]), 0, 0))
            at += n
        return _sent(rows)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out, m = [], model.value
        keys, counts = unpack(right["keys"], np.uint64), unpack(right["counts"], np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        ends = int(counts[np.searchsorted(keys, _END)]) if len(keys) else 0
        for batch in slices(left.to_batches(), "__text", 4 << 20):
            v = Vocabulary(batch.column("__text"), path)
            c = counts[np.searchsorted(keys, v.keys)] if len(v.keys) else np.zeros(0, np.int64)
            x, y, begin, length = m.sequences(v)
            doc, n = v.words.docs(), batch.num_rows
            known = sum_by(doc, c[v.code] > 0, n) + (ends > 0)
            base = sum_by(doc, np.log10(c[v.code] + 1.0), n) + np.log10(ends + 1.0)
            words = sum_by(doc, m.word_logs(v, c)[v.code], n)
            context = np.add.reduceat(attention.score(m.weights, x, begin, length, y), begin)
            out.append(pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(length), pa.array(known.astype(np.int64)), pa.array(base), pa.array((words + context) / np.log(10))], names=["__id", "n_tokens", "n_known", "base", "score"]))
        return pa.Table.from_batches(out)

    answers = homed.applyInArrow(ask, _SENT).groupBy("bucket").applyInArrow(answer, _SENT)
    scored = homed.cogroup(answers.where("home >= 0").groupBy("home")).applyInArrow(judge, f"__id {kind}, n_tokens long, n_known long, base double, score double")
    totals = answers.where("home < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"))  # one row
    per_token = F.log10(F.col("train_tokens") + 1 * (F.col("v") + 1))
    return scored.join(F.broadcast(totals)).select(F.col("__id").alias(id_col), "n_tokens", "n_known", "train_tokens", (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score")
