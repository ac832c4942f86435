"""Helpers of the operators against plain restatements, without Spark."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from ragtables.llm import attention, multiindex, neardup, packing, pieces, stats, substrings, textkit, toxicity

WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", None, "one", " lead  and\ttrail \n", "é中 x\xa0y​z", "a\n\nb\r\nc", "x" * 5000, "Same Same same", "it's 'll don't 12 3.5 #tag\n \n- x"]


def test_words():
    w = textkit.Words(*textkit.buffers(pa.array(ODD)))
    got = textkit.spans(w.data, w.starts, w.ends)
    want = [re.findall(WORD, t or "") for t in ODD]
    assert got == [x for t in want for x in t] and w.counts.tolist() == list(map(len, want))
    h, low = w.hashes(), w.hashes(lower=True)
    for i in range(len(got)):
        for j in range(i):
            assert (h[i] == h[j]) == (got[i] == got[j])
    assert len({x for x, t in zip(low.tolist(), got) if t.lower() == "same"}) == 1


def thue_morse(n, a="a", b="b"):
    """Two words of n letters that sums of letter values times powers of any base modulo 2^64 take for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_hashes_tell_words_apart():
    r = random.Random(1)
    listed = [w for n in (64, 256, 1024, 2048, 4096, 8192) for w in thue_morse(n)]
    listed += ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    listed += [chr(97 + i % 26) * (i // 26 + 1) for i in range(26 * 300)]
    spots = [" ".join(listed), "  x " + "\n".join(listed[::-1])]  # the same words elsewhere in the bytes
    for seed in (0, 1):
        seen = {}
        for w in (textkit.Words(*textkit.buffers(pa.array([t]))) for t in spots):
            for h, x in zip(w.hashes(seed=seed).tolist(), textkit.spans(w.data, w.starts, w.ends), strict=True):
                assert seen.setdefault(h, x) == x
        assert len(seen) == len({*listed, "x"})


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (1, 9, 30, 2, 2)])], names=["t"])
    parts = list(textkit.slices([batch], "t", 10))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist() and len(parts) == 3


def test_difference_cover():
    for v in (1, 2, 3, 7, 10):
        d = substrings.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert len(substrings.difference_cover(7)) == 3


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = [x or "" for x in ODD] + ["a  b \n\nc\td  ", " end \n", "<|endoftext|> x", "Ünïcödé têxt and\nmore", "<|endoftext|><|endoftext|>", "a <|endoftext|> b\n<|endoftext|>\n", "<|endo", "ftext|> over the edge", "<|endoftext|"]
    texts += ["|>", " x", *(("y" * n) + "<|endoftext|> z" for n in range(3))]
    ids, at = packing.token_ids(*textkit.buffers(pa.array(texts)), packing.default_tokenizer())
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


def test_plan():
    r = random.Random(3)
    for _ in range(40):
        lengths = Counter(r.choice([r.randint(1, 60), r.randint(1, 8), 64]) for _ in range(r.randint(0, 300)))
        made = packing.plan(lengths, 64)
        used = Counter()
        for row, times in made:
            assert sum(row) <= 64 and times > 0
            for n in row:
                used[n] += times
        assert used == lengths
    assert sum(t for _, t in packing.plan({500: 7, 524: 7, 300: 3, 200: 3, 24: 3, 1024: 2})) == 11


def test_automaton():
    terms = ["idiot", "stupid", "scum", "trash"]
    trie = toxicity.Trie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(400):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "t"])
        w = "".join(w)
        near = sorted(i for i, t in enumerate(terms) if distance(w, t) <= 1)
        assert sorted(toxicity.LevenshteinAutomaton(w).intersect(trie)) == near
        gaps = set(toxicity._gaps([w])[0].tolist())
        assert all(gaps & set(toxicity._gaps([terms[i]])[0].tolist()) for i in near)


def test_quotation():
    lexicon = toxicity.Lexicon(["idiot"], np.array([3.0]))
    x = lexicon.features(pa.array(['he said "you idiot" and left', "you idiot", "you idiott", "fine", None]))
    assert x[0][0] == 0 and x[0][1] > 0 and x[1][0] > 0 and x[2][2] > 0 and not x[3][:4].any() and not x[4][:4].any()


def test_alignment():
    r = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a = [r.randint(0, r.choice([2, 50])) for _ in range(r.randint(1, 50))]
        b = list(a)
        for _ in range(r.randint(0, 20)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice([[], [99], [1, 2]])
        most = r.randint(0, 30)
        assert neardup.alignment_within(np.array(a), np.array(b, int), most) == min(distance(a, b), most + 1)


def test_statistics():
    texts = [*ODD, "a b c d e f a b c d e g", "line\nline\n \nline \n", "# * $ % & | < > x"]
    c = stats.text_counts(pa.array(texts))
    for i, t in enumerate(texts):
        words = re.findall(WORD, t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        n = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = [False] * len(words)
        for k in range(len(words) - 4):
            if n[tuple(words[k : k + 5])] > 1:
                hit[k : k + 5] = [True] * 5
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(hit))
        assert tuple(int(c[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def one_pass(v, chars):
    """Ids by one pass over all characters, the longest last piece among equals."""
    best, back = [0], [None]
    for i in range(1, len(chars) + 1):
        options = []
        for k in range(1, min(v.longest, i) + 1):
            s, p = v.edges(chars[i - k : i], np.array([0]), np.array([k]))
            options.append((best[i - k] + int(s[0]), k, int(p[0])))
        best.append(max(options)[0])
        back.append(max(options)[1:])
    out, i = [], len(chars)
    while i:
        k, p = back[i]
        c = chars[i - k]
        out += [v.ids[p]] if p >= 0 else [v.byte_ids[b] for b in chr(pieces.MARK if c == pieces.LITERAL else c).encode()][::-1]
        i -= k
    return out[::-1], best[-1]


@pytest.mark.parametrize("letters", ["abcthe   inerona\n▁é0019.,x中", "aathein", "x", "xxxxxy"])
def test_scan_equals_one_pass(letters):
    v, r = pieces.vocabulary(pieces.default_model()), random.Random(1)
    for _ in range(25):
        x = "".join(r.choice(letters) for _ in range(r.randint(1, 90)))
        chars, at = pieces.characters(pa.array([x]))
        ids, edge = v.encode(chars, at)
        want, best = one_pass(v, chars)
        assert ids.tolist() == want and int(v._scores()[ids].sum()) == best
        assert v.decode(ids, edge)[0].tobytes().decode() == x
        size, rows = r.choice([3, 7, 20, 40]), []
        begin = range(0, len(x), size)
        first = np.array([a == 0 for a in begin])
        c, at = pieces.characters(pa.array([x[a : a + size + v.longest - 1] for a in begin]), first)
        n = np.array([min(size, len(x) - a) for a in begin]) + first
        made = v.transfers(c, at, n)
        made[-1].worth[:, 1:] = pieces.NEVER
        s = pieces.edge_states(made)
        edge = r.randint(1, len(made))  # the same by two blocks
        blocks = [reduce(pieces.combine, b) for b in (made[:edge], made[edge:]) if b]
        outer = pieces.edge_states(blocks)
        inner = pieces.edge_states(made[:edge], 0, outer[1])
        if len(blocks) > 1:
            inner += pieces.edge_states(made[edge:], outer[1], 0)[1:]
        assert inner == s
        for k in range(len(n)):
            part = c[at[k] + s[k] : at[k] + n[k] + s[k + 1]]
            rows += v.encode(part, np.array([0, len(part)]))[0].tolist()
        assert rows == want


def test_products_are_associative():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b, c = (pieces.Transfer(r.integers(-3, 3, (4, 4)), r.permuted(np.tile(np.arange(4)[:, None], 4), axis=0)) for _ in range(3))
        x, y = pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c))
        assert (x.worth == y.worth).all() and (x.order == y.order).all()


def test_walk_visits_cells_in_order():
    r = np.random.default_rng(2)
    left, right = r.random(5), r.random(6)
    cells = multiindex.walk(left, right, np.ones(30, int), 30)
    sums = [left[c // 6] + right[c % 6] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)


def test_attention_gradients_equal_differences():
    r = np.random.default_rng(3)
    classes = attention.GROUPS * attention.MEMBERS
    p = {k: v.astype(np.float64) for k, v in attention.initial(30, r.integers(0, 9, classes)).items()}
    ids, targets = r.integers(0, 30, (3, attention.SPAN)), r.integers(0, classes, (3, attention.SPAN))
    real = np.arange(attention.SPAN) < np.array([[attention.SPAN], [20], [1]])
    g, _ = attention.gradients(p, ids, real, targets)
    for k in p:
        for at in [tuple(r.integers(0, n) for n in p[k].shape) for _ in range(4)] + [np.unravel_index(np.abs(g[k]).argmax(), p[k].shape)]:
            old, loss = p[k][at], []
            for step in (1e-4, -1e-4):
                p[k][at] = old + step
                loss.append(attention.gradients(p, ids, real, targets)[1])
            p[k][at] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))


def test_attention_scores_each_place_once():
    r = np.random.default_rng(4)
    classes = attention.GROUPS * attention.MEMBERS
    p = attention.initial(30, r.integers(0, 9, classes))
    lengths = np.array([1, 50, 200])
    begin = np.cumsum(lengths) - lengths
    flat, targets = r.integers(0, 30, lengths.sum()), r.integers(0, classes, lengths.sum())
    got = attention.score(p, flat, begin, lengths, targets)
    assert (got < 0).all()
    for b, n in zip(begin, lengths):  # a text scores the same alone
        assert np.allclose(attention.score(p, flat[b : b + n], np.array([0]), np.array([n]), targets[b : b + n]), got[b : b + n], atol=1e-5)
    every = np.arange(classes)
    total = attention.log_probabilities(p, np.repeat(r.normal(size=(1, attention.WIDTH)), classes, 0), every)
    assert abs(np.exp(total).sum() - 1) < 1e-6


def _plain_score(p: dict, ids: np.ndarray, targets: np.ndarray) -> list[float]:
    """Place by place, by dense softmaxes in double precision; the sequence is one text."""
    p, out = {k: v.astype(np.float64) for k, v in p.items()}, []
    for t, c in enumerate(targets):
        start = t // attention.FRESH * attention.FRESH - attention.CONTEXT
        seen = np.arange(max(start, 0), t + 1)
        x = p["E"][ids[seen]] + p["P"][seen - start]
        s = (x @ p["K"]) @ (x[-1] @ p["Q"]) / attention.WIDTH**0.5
        a = np.exp(s - s.max())
        h = x[-1] + a @ (x @ p["V"]) / a.sum()
        g, m = divmod(int(c), attention.MEMBERS)
        upper, lower = h @ p["O"] + p["B"], h @ p["M"][g] + p["C"][g]
        out.append(upper[g] - np.logaddexp.reduce(upper) + lower[m] - np.logaddexp.reduce(lower))
    return out


def test_attention_scores_do_no_more_work_than_the_scored_places_need(monkeypatch):
    """Attention rows of the scored places only, and the softmaxes of group and member; flat and steep weights give plain results."""
    r = np.random.default_rng(6)
    classes = attention.GROUPS * attention.MEMBERS
    n = 4 * attention.FRESH
    ids, targets = r.integers(0, 30, n), r.integers(0, classes, n)
    made, exp = [], np.exp

    def counted(z, **more):
        made.append(np.size(z))
        return exp(z, **more)

    for scale in (1, 12):  # the second leaves single precision unless rows are shifted by their maxima
        p = attention.initial(30, r.integers(0, 9, classes))
        p |= {k: p[k] * np.float32(scale) for k in "EQKOM"}
        with monkeypatch.context() as m:
            m.setattr(np, "exp", counted)
            got = attention.score(p, ids, np.array([0]), np.array([n]), targets)
        want = _plain_score(p, ids, targets)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert sum(made) <= 2 * n * (attention.SPAN + attention.GROUPS + attention.MEMBERS)


def test_attention_gradients_do_not_depend_on_the_shift(monkeypatch):
    r = np.random.default_rng(8)
    classes = attention.GROUPS * attention.MEMBERS
    p = attention.initial(30, r.integers(0, 9, classes))
    ids, targets = r.integers(0, 30, (5, attention.SPAN)), r.integers(0, classes, (5, attention.SPAN))
    real = np.arange(attention.SPAN) < np.array([[attention.SPAN], [20], [1], [attention.SPAN], [47]])
    (free, loss), _ = attention.gradients(p, ids, real, targets), monkeypatch.setattr(attention, "SAFE", 0.0)
    shifted, same = attention.gradients(p, ids, real, targets)
    assert abs(loss - same) < 1e-4 and all(free[k].shape == p[k].shape and np.allclose(free[k], shifted[k], rtol=1e-3, atol=1e-6) for k in p)


def test_distinct():
    for keys in (np.zeros(0, np.uint64), np.array([2**64 - 1, 5, 0, 5, 2**63, 2**64 - 1], np.uint64)):
        own, first, code = textkit.distinct(keys)
        assert own.dtype == np.uint64 and (own[code] == keys).all() and (keys[first] == own).all()
        assert sorted(first) == sorted(np.unique(keys, return_index=True)[1])
