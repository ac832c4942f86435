"""Toxicity from a learned lexicon, matched tolerantly and read in context.

The lexicon is the words that labelled toxic documents have far more often than
labelled clean ones. It becomes a trie; a Levenshtein automaton of each unknown
word is run against the trie, so misspelled terms count as well. Each hit is
read in the window around it: inside quotation marks it counts as quotation,
else as abuse, and hits that crowd together raise the score. A logistic
regression turns these window figures into a probability. Its training rows get
their figures from a lexicon learned without them (two folds).

Nothing but the text enters a score. Labels are read from at most `sample`
labelled documents (by a hash of the id), so the model is bounded; scoring
covers all rows.

Defined results: null and empty texts get the score of a text without hits; a
null id is carried through; repeated rows get equal scores; an empty table gives
no rows; without labels of both kinds every score is the share of toxic labels
(0 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import NOT_ALNUM, Words, buffers, logistic, mix, sigmoid, slices, span_hashes, spans, sum_by

SAMPLE = 40_000
TERMS = 2000
WINDOW = 25  # words to either side
THRESHOLD = 0.3
_LONGEST = 26
_TOGETHER = 16_384  # words whose neighbours are looked up at once
_BATCH = 2 << 20


class Trie:
    """Terms by their characters; a term's number is stored where it ends."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = i


class LevenshteinAutomaton:
    """Accepts what is at most one edit from the word.

    A state is two sets of places in the word, as the bits of two integers: those reached without an edit, and with one.
    """

    def __init__(self, word: str):
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << (i + 1)
        self.full, self.end = (1 << (len(word) + 1)) - 1, 1 << len(word)

    def start(self) -> tuple[int, int]:
        return 1, 3 & self.full  # at once, or with the word's first character left out

    def step(self, state: tuple[int, int], c: str) -> tuple[int, int]:
        exact, edited = state
        here = self.at.get(c, 0)
        now = (exact << 1) & here
        # go on after an edit; or c is added, stands for another, or the word's next character is left out
        return now, (((edited << 1) & here) | exact | exact << 1 | now | now << 1) & self.full

    def accepts(self, state: tuple[int, int]) -> bool:
        return bool((state[0] | state[1]) & self.end)

    def intersect(self, trie: Trie) -> list[int]:
        """Numbers of the trie's terms that the automaton accepts."""
        found, todo = [], [(trie.root, self.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if self.accepts(state):
                        found.append(child)
                else:
                    after = self.step(state, c)
                    if after[0] | after[1]:
                        todo.append((child, after))
        return found


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row per word, and lengths."""
    m = np.array(words, f"<U{_LONGEST}") if words else np.zeros(0, f"<U{_LONGEST}")
    m = m.view(np.uint32).reshape(len(words), _LONGEST).astype(np.uint64)
    return m, (m > 0).sum(1)


def _gaps(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each word with one character left out (and of the word itself), with word numbers.

    Two words one edit apart share one of these; what shares none need not be run through the automaton.
    """
    m, n = _matrix(words)
    value = mix(m + np.uint64(1)) * (m > 0)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_LONGEST, base, np.uint64)]))
    here, left = value * power[:-1], value * np.concatenate([np.zeros(1, np.uint64), power[: _LONGEST - 1]])
    upto = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(here, 1)], 1)
    shifted = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(left, 1)], 1)
    out, who = [mix(upto[:, -1])], [np.arange(len(words))]
    for i in range(_LONGEST):
        x = np.flatnonzero(n > i)
        out.append(mix(upto[x, i] + shifted[x, -1] - shifted[x, i + 1]))
        who.append(x)
    return np.concatenate(out), np.concatenate(who)


@dataclass
class Lexicon:
    """Terms with their log-odds; finds them in batches of texts."""

    terms: list[str]
    weights: np.ndarray
    fuzzy_from: int = 5  # shorter terms must match exactly
    _seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    _code: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def _ready(self) -> None:
        if not hasattr(self, "trie"):
            raw = [t.encode() for t in self.terms]
            ends = np.cumsum([len(x) for x in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            hashes = span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(raw)], ends, lower=True)
            self.order = np.argsort(hashes)
            self.hashes = hashes[self.order]
            long = [t for t in self.terms if self.fuzzy_from <= len(t) < _LONGEST]
            place = {t: i for i, t in enumerate(self.terms)}
            self.number = [place[t] for t in long]
            self.trie, self.near = Trie(long), np.unique(_gaps(long)[0])

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "fuzzy_from": self.fuzzy_from, "_seen": np.zeros(0, np.uint64), "_code": np.zeros(0, np.int64)}

    def codes(self, w: Words) -> np.ndarray:
        """For each word: 0, or 1 + the term's number, negative if misspelled."""
        self._ready()
        hashes = w.hashes(lower=True)
        new, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._seen, new)
        known = np.zeros(len(new), bool)
        inside = at < len(self._seen)
        known[inside] = self._seen[at[inside]] == new[inside]
        code = np.zeros(len(new), np.int64)
        code[known] = self._code[at[known]]
        fresh = np.flatnonzero(~known)
        if len(self.hashes) and len(fresh):
            k = np.minimum(np.searchsorted(self.hashes, new[fresh]), len(self.hashes) - 1)
            exact = self.hashes[k] == new[fresh]
            code[fresh[exact]] = self.order[k[exact]] + 1
            rest = fresh[~exact]
            size = (w.ends - w.starts)[first[rest]]
            rest = rest[(size >= self.fuzzy_from - 1) & (size <= 4 * _LONGEST)]
            for part in np.array_split(rest, len(rest) // _TOGETHER + 1) if len(self.near) else ():
                words = [x.lower() for x in spans(w.data, w.starts[first[part]], w.ends[first[part]])]
                fit = [i for i, x in enumerate(words) if self.fuzzy_from - 1 <= len(x) < _LONGEST and not x.isdigit()]
                gaps, who = _gaps([words[i] for i in fit])
                for i in np.unique(who[np.isin(gaps, self.near)]).tolist():
                    hits = LevenshteinAutomaton(words[fit[i]]).intersect(self.trie)
                    if hits:
                        code[part[fit[i]]] = -1 - max((self.number[h] for h in hits), key=lambda t: self.weights[t])
        if len(fresh) and len(self._seen) < 2_000_000:
            merged = np.concatenate([self._seen, new[fresh]])
            order = np.argsort(merged, kind="stable")
            self._seen, self._code = merged[order], np.concatenate([self._code, code[fresh]])[order]
        return code[back]

    def features(self, column: pa.Array) -> np.ndarray:
        """One row of window figures for each text."""
        data, offsets = buffers(column)
        w = Words(data, offsets, NOT_ALNUM)
        code = self.codes(w)
        hit = np.flatnonzero(code)
        doc = np.searchsorted(w.ptr, hit, side="right") - 1
        n = len(offsets) - 1
        weight = self.weights[np.abs(code[hit]) - 1] if len(hit) else np.zeros(0)
        quoted = _quoted(data, offsets, w, hit, doc)
        misspelled = code[hit] < 0
        # how many hits lie within the window around each
        near = np.minimum(np.searchsorted(hit, hit + WINDOW, side="right"), np.searchsorted(doc, doc, side="right")) - np.maximum(np.searchsorted(hit, hit - WINDOW), np.searchsorted(doc, doc))
        crowd = np.zeros(n)
        np.maximum.at(crowd, doc, np.where(quoted | misspelled, 0, near))
        kinds = [~quoted & ~misspelled, quoted & ~misspelled, ~quoted & misspelled, quoted & misspelled]
        sums = [sum_by(doc[k], weight[k], n) for k in kinds]
        best = np.zeros(n)
        np.maximum.at(best, doc[kinds[0]], weight[kinds[0]])
        size = np.maximum(w.counts, 1)
        return np.stack([*(np.log1p(x) for x in sums), *(np.log1p(100 * x / size) for x in (sums[0], sums[2])), best, np.log1p(crowd), np.log1p(size) / 10], 1)


def _quoted(data, offsets, w: Words, hit, doc) -> np.ndarray:
    """Whether a quotation mark opens before each hit and closes after it, within the window."""
    marks = np.flatnonzero(data == 34)
    high = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))) if len(data) > 1 else np.zeros(0, np.int64)
    curly = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] >= 0x9C) & (data[2:] <= 0x9E))) if len(data) > 2 else np.zeros(0, np.int64)
    marks = np.sort(np.concatenate([marks, high, curly]))
    if not len(marks) or not len(hit):
        return np.zeros(len(hit), bool)
    before = np.searchsorted(marks, w.starts[hit])
    odd = (before - np.searchsorted(marks, offsets[doc])) % 2 == 1
    last, nxt = marks[np.maximum(before - 1, 0)], marks[np.minimum(before, len(marks) - 1)]
    left = w.starts[np.maximum(hit - WINDOW, w.ptr[doc])]
    right = w.ends[np.minimum(hit + WINDOW, w.ptr[doc + 1] - 1)]
    return odd & (last >= left - 1) & (before < len(marks)) & (nxt >= w.starts[hit]) & (nxt <= right)


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.coefficients):
            return np.full(len(column), self.share)
        x = self.lexicon.features(column)
        return sigmoid(x @ self.coefficients[:-1] + self.coefficients[-1])


LEAST = 15.0  # log-likelihood ratio from which a word stands out


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, terms: int, least: float = LEAST) -> Lexicon:
    made, share = [], toxic / max(1, toxic + clean)
    for word, t, c in counts:
        if t >= 2:
            odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
            ratio = 2 * (t * np.log(t / ((t + c) * share)) + (c * np.log(c / ((t + c) * (1 - share))) if c else 0))
            if odds > 1.2 and ratio >= least:
                made.append((-ratio, word, odds))
    made.sort()
    return Lexicon([w for _, w, _ in made[:terms]], np.array([o for *_, o in made[:terms]]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """A model from the labelled documents. labels: one row per labelled id; hold out rows by leaving them away."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("__y"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * sample // n)))
    labels = labels.limit(2 * sample)  # the sample is about this by its hash; the limit makes it a proven bound for the broadcast
    fold = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(2)).cast("int")
    known = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(labels), id_col).select("__text", "__y", fold.alias("__fold"))

    def count(batches):
        """For each word of a batch: in how many texts of each fold and label it is."""
        for batch in slices(batches, "__text", _BATCH):
            y, part = batch.column("__y").to_numpy(zero_copy_only=False), batch.column("__fold").to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("__text"))
            w = Words(data, offsets, NOT_ALNUM)
            h, first, back = np.unique(w.hashes(lower=True), return_index=True, return_inverse=True)
            pair = np.unique(back.astype(np.int64) * batch.num_rows + w.docs())
            word, doc = pair // batch.num_rows, pair % batch.num_rows
            got = np.stack([np.bincount(word[(y[doc] == t) & (part[doc] == k)], minlength=len(h)) for k in (0, 1) for t in (1, 0)])
            columns = [pa.array([x.lower() for x in spans(data, w.starts[first], w.ends[first])], pa.string())] + [pa.array(g.astype(np.int64)) for g in got]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "t0", "c0", "t1", "c1"])

    totals = {(r["__fold"], r["__y"]): r["count"] for r in known.groupBy("__fold", "__y").count().collect()}
    both = {y: sum(v for (_, k), v in totals.items() if k == y) for y in (0, 1)}
    share = both[1] / max(1, both[0] + both[1])
    if not both[0] or not both[1]:
        return Model(Lexicon([], np.zeros(0)), np.zeros(0), share)
    sums = known.mapInArrow(count, "word string, t0 long, c0 long, t1 long, c1 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))
    # bounded: the terms that stand out most
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    ratio = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    top = sums.where((t >= 3) & (F.length("word") >= 3) & (t > (t + c) * share)).orderBy(ratio.desc(), "word").limit(4 * terms).collect()
    whole = _lexicon([(r["word"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in top], both[1], both[0], terms)
    halves = [_lexicon([(r["word"], r[f"t{k}"], r[f"c{k}"]) for r in top], totals.get((k, 1), 0), totals.get((k, 0), 0), terms, LEAST / 2) for k in (0, 1)]

    def figures(batches):
        for batch in slices(batches, "__text", _BATCH):
            part = batch.column("__fold").to_numpy(zero_copy_only=False)
            x = np.stack([lexicon.features(batch.column("__text")) for lexicon in halves])[1 - part, np.arange(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("__y")], names=["x", "y"])

    rows = known.mapInArrow(figures, "x array<double>, y int").toPandas()
    return Model(whole, logistic(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches, "__text", _BATCH):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column("__text")))], names=[id_col, "score"])

    return frame.mapInArrow(run, f"`{id_col}` {frame.schema[0].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id", by: int = 4):
    """Rows whose labels are not learned from: crc32 of the id as text leaves 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by)) == 2


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col)
    return score(docs, model, id_col, text_col).select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that reach the threshold. The decision is made on the row itself, so no join is needed."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col)

    def run(batches):
        for batch in slices(batches, text_col, _BATCH):
            yield batch.filter(pa.array(model.score(batch.column(text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)
