"""Resampling, mixing and the manifest against plain restatements."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragtables.llm import merkle, mixing, prefixcrc, queries, resampling

KINDS = ["odd", "empty", "one short", "only nulls", "no words", "repeated", "short partition"]
LOW = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# running CRCs


def test_crc_of_substrings():
    r = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000, 200_003):
        data = r.integers(0, 256, size).astype(np.uint8)
        crc = prefixcrc.RunningCrc(data)
        a = r.integers(0, size + 1, 300)
        b = np.minimum(a + r.integers(0, 3000, 300), size)
        assert prefixcrc.between(crc.at(a), crc.at(b), b - a).tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(a, b)]


def features(text, longest=2):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


@pytest.mark.parametrize("piece", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_in_pieces(piece, longest):
    texts = [None, "", "One two  THREE é-Ü x", "a", "...", "z" * 300 + " q", "x_y[1]{2}"] * 3
    words = resampling._words(pa.array(texts))
    got = sorted((int(d), int(c)) for docs, crcs in resampling.feature_crcs(words, longest, piece) for d, c in zip(docs, crcs))
    assert got == sorted((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in features(t, longest)[1])


def plain_resample(docs, target, buckets=10_000):
    s, t = (Counter(zlib.crc32(f.encode()) % buckets for x in texts for f in features(x)[1]) for texts in ([d for _, d in docs], target))
    of_s, of_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        ws, fs = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(sha(f"7:{i}")[:8], 16) + 0.5) / 2**32)))
        out.append([i, len(fs), weight, score, None, len(ws)])
    able = sorted((x for x in out if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0], x[1], x[2]))
    for n, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = n + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("kind", KINDS)
def test_resampling(spark, tables, kind):
    docs = tables[kind]
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,), ("long word",)], "text string")
    got = resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    plain = plain_resample([(r.doc_id, r.text) for r in docs.collect()], ["w1 w2 w3 w4", None, "long word"])
    assert Counter(map(tuple, got)) == plain
    drawn = resampling.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got if r.rank}


def test_resampling_towards_nothing(spark, tables):
    docs = tables["odd"]
    got = resampling.resample(docs, docs.select("text").limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [])


def test_resampling_prefers_the_target(spark):
    r = random.Random(5)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(near if i % 4 == 0 else far) for _ in range(40))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(r.choice(near) for _ in range(40)),) for _ in range(50)], "text string")
    drawn = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(drawn) == 100 and sum(x.doc_id % 4 == 0 for x in drawn) >= 70


# mixing


def plain_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Shares by weight, what is above goes to the others again and again."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    got, open_, rest = dict.fromkeys(order, Fraction(0)), set(order), share * sum(sizes.values())
    while rest > 0 and open_:
        w = sum(weight[k] for k in open_)
        for k in open_:
            got[k] += rest * weight[k] / w
        rest = Fraction(0)
        for k in [k for k in open_ if got[k] >= most * sizes[k]]:
            rest += got[k] - most * sizes[k]
            got[k] = Fraction(most * sizes[k])
            open_.remove(k)
    return got


def plain_seats(votes, seats):
    got, heap = dict.fromkeys(votes, 0), [(-Fraction(v), k) for k, v in votes.items() if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-Fraction(votes[k], 2 * got[k] + 1), k))
    return got


def test_apportion(spark):
    r = random.Random(6)
    groups = {f"g{n}": ({i: r.choice([0, 1, r.randint(1, 9), r.randint(1, 10**6)]) for i in range(r.randint(1, 30))}, r.randint(0, 400)) for n in range(12)}
    groups["even"], groups["none"], groups["hot"] = ({i: 7 for i in range(20)}, 33), ({0: 0, 1: 0}, 5), ({0: 10**9, **{i: 1 for i in range(1, 40)}}, 9000)
    df = spark.createDataFrame([(g, i, v, n) for g, (votes, n) in groups.items() for i, v in votes.items()], "g string, i int, v long, n long")
    got = defaultdict(dict)
    for x in mixing.apportion(df, "v", "n", ["i"], within=("g",)).collect():
        got[x.g][x.i] = x.quota
    assert got == {g: plain_seats(*x) for g, x in groups.items()}
    alone = mixing.apportion(df.where("g = 'g3'").drop("g"), "v", "n", ["i"]).collect()
    assert {x.i: x.quota for x in alone} == plain_seats(*groups["g3"])


def test_targets(spark):
    r = random.Random(8)
    for n in (1, 2, 5, 40):
        sizes = {k: r.choice([0, r.randint(1, 10), r.randint(1, 10**6)]) for k in [f"s{i}" for i in range(n)] + (["é", "z", None] if n > 2 else [])}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        want = plain_targets(sizes)
        for x in got.collect():
            assert math.isclose(x.target, want[x.source], rel_tol=1e-9, abs_tol=1e-9)


def check_mix(rows, docs, block):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = plain_targets(sizes), Counter()
    assert len(rows) == len(docs)
    for x in rows:
        assert 0 <= x.taken <= 2 * x.size and x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], abs_tol=1e-6)
        assert x.taken == sum((s.end - s.start) * s.copies for s in x.spans) and all(0 <= s.start < s.end <= x.size for s in x.spans)
        taken[x.source] += x.taken
    for k, n in sizes.items():
        assert abs(taken[k] - want[k]) <= 2 * block, (k, n, taken[k], want[k])


@pytest.mark.parametrize("kind,shard", [*((k, 1 << 22) for k in KINDS), ("odd", 100)])
def test_mixing(spark, tables, kind, shard):
    docs = tables[kind]
    rows = mixing.mix_sources(docs, shard_words=shard).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()], 16 if shard > 100 else 60)
    if kind in ("odd", "repeated"):
        again = mixing.mix_sources(docs.repartition(5), shard_words=shard).collect()
        assert Counter(map(str, rows)) == Counter(map(str, again))


def test_mixed_texts(spark, tables):
    docs = tables["odd"].where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mix_sources(docs)
    got, text = defaultdict(Counter), {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    for r in mixing.mixed_texts(docs, mixed).collect():
        got[r.doc_id].update(r.text.split(" "))
    for r in mixed.collect():
        want = Counter()
        for s in r.spans:
            for _ in range(s.copies):
                want.update(text[r.doc_id][s.start : s.end])
        assert got[r.doc_id] == want
    with pytest.raises(ValueError):
        mixing.mixed_texts(tables["repeated"], mixing.mix_sources(tables["repeated"]))


# manifest


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fan=8):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_path(levels, i, fan=8):
    out = []
    for level in levels[:-1]:
        a = i - i % fan
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
        i //= fan
    return out


def plain_manifest(rows, fan=8):
    groups = defaultdict(list)
    for r in rows:
        changed = None if r.text is None else r.text.translate(LOW)
        other = changed if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else r.text
        groups[r.lang].append((r.doc_id, plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, other)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[k] = plain_tree([x[1] for x in groups[k]], fan)
    crown, out = plain_tree([trees[k][-1][0] for k in order], fan), Counter()
    for g, k in enumerate(order):
        for i, (doc_id, leaf, other) in enumerate(groups[k]):
            path = plain_path(trees[k], i, fan) + plain_path(crown, g, fan)
            held = other
            for a, b in path:
                held = sha(a + held + b)
            root = crown[-1][0]
            out[doc_id, leaf, trees[k][-1][0], root, sha("".join(a + b for a, b in path)), held, held == root] += 1
    return out


@pytest.mark.parametrize("kind,fan,depth", [*((k, 8, 2) for k in KINDS), ("odd", 3, 2), ("repeated", 2, 1)])
def test_manifest(spark, tables, kind, fan, depth):
    docs = tables[kind]
    changed = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    got = merkle.verified(merkle.manifest(docs, changed=changed, fan=fan, depth=depth)).collect()
    assert Counter(map(tuple, got)) == plain_manifest(docs.collect(), fan)


def test_manifest_of_many_groups(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", f"lang{i % 77}", "s", 1) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    changed = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    got = merkle.verified(merkle.manifest(docs, changed=changed)).collect()
    assert Counter(map(tuple, got)) == plain_manifest(docs.collect())
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("name", ["op11_prefix_crc_resampling", "op12_sainte_lague_mixing", "op13_merkle_manifest"])
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), c.sql(queries.oracle_sql()[name])
    at = [want.columns.index(x) for x in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
