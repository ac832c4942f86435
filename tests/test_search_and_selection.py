from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragtables.functions import spans
from ragtables.operators import catalog, diversity, encode, promote, rerank, search
from ragtables.operators import terms as terms_module
from ragtables.params import Params
from ragtables.plans import retrieve
from ragtables.queries import inputs

HITS = "query_id string, rank int, chunk_id string, document_id string, filename string, chunk_index int, page int, text string, score double, vector array<double>"


def hits(spark, rows):
    """rows: (document, index, text, score, vector)"""
    return spark.createDataFrame([("q", i + 1, f"{d}:{n}", d, f"{d}.pdf", n, None, t, float(s), v) for i, (d, n, t, s, v) in enumerate(rows)], HITS)


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_greedy_choice():
    sim = np.full((3, 3), 0.1)
    sim[0, 1] = sim[1, 0] = 0.99
    assert diversity._greedy(np.array([1.0, 0.95, 0.6]), sim, 0.5, 2, 1.01) == [0, 2]
    sim = np.full((3, 3), 0.2)
    sim[0, 1] = sim[1, 0] = 0.99
    assert diversity._greedy(np.array([1.0, 0.99, 0.5]), sim, 0.7, 3, 0.95) == [0, 2]
    assert diversity._greedy(np.ones(3), np.ones((3, 3)), 0.7, 3, 0.88) == [0]


def test_greedy_equals_plain_search():
    r = np.random.default_rng(4)
    for _ in range(60):
        n, k, w, cap = int(r.integers(1, 9)), int(r.integers(1, 9)), float(r.random()), float(r.choice([0.4, 0.8, 2]))
        score, v = r.random(n), r.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sim, span = v @ v.T, score.max() - score.min()
        rel = np.ones(n) if span < 1e-9 else (score - score.min()) / span
        chosen = []
        while len(chosen) < k:
            options = [(w * rel[i] - (1 - w) * max((sim[i, j] for j in chosen), default=0.0), -i) for i in range(n) if i not in chosen and max((sim[i, j] for j in chosen), default=0.0) < cap]
            if not options:
                break
            chosen.append(-max(options)[1])
        assert diversity._greedy(score, sim, w, k, cap) == chosen


def test_mmr_on_vectors_and_fallback(spark):
    rows = hits(spark, [("A", 0, "a", 1.0, [1.0, 0.0, 0.0]), ("A", 1, "b", 0.98, [0.99, 0.01, 0.0]), ("B", 0, "c", 0.7, [0.0, 1.0, 0.0])])
    assert ids(diversity.mmr_select(rows, 2, 0.5, 1.01)) == ["A:0", "B:0"]
    assert ids(diversity.mmr_select(rows.withColumn("vector", F.lit(None).cast("array<double>")), 2)) == ["A:0", "A:1"]


def test_dedupe_by_text(spark):
    t = "the quick brown fox jumps over dogs"
    assert ids(diversity.dedupe_by_text(hits(spark, [("A", 0, t, 3, None), ("A", 1, t.upper() + "!", 2, None), ("B", 0, "else", 1, None)]))) == ["A:0", "B:0"]
    assert ids(diversity.dedupe_by_text(hits(spark, [("A", 0, t, 3, None), ("A", 1, t + " today", 2, None), ("B", 0, "other words", 1, None)]))) == ["A:0", "B:0"]


def test_rerank_by_given_scores(spark):
    rows = hits(spark, [("A", 0, "0.1", 3, None), ("A", 1, "0.9", 2, None), ("A", 2, "0.4", 1, None)])
    got = rerank.rerank(rows, spark.createDataFrame([("q", "x")], "query_id string, query string"), lambda q, t: t.cast("double"))
    assert ids(got) == ["A:1", "A:2", "A:0"] and got.where("rank = 1").first()["score"] == 0.9


def test_promotion(spark):
    rows = hits(spark, [("A", 0, "an overview", 0.9, None), ("A", 1, "m5.xlarge has 4 vCPUs", 0.4, None)])
    asked = spark.createDataFrame([("q", "vCPUs of M5.xlarge?")], "query_id string, query string")
    assert ids(promote.promote_hits(rows, rows, asked, 1)) == ["A:1"]
    assert ids(promote.promote_hits(rows, rows, asked, 2)) == ["A:0", "A:1"]
    family = hits(spark, [("A", 0, "an overview", 0.9, None), ("A", 1, "Memory optimized instances are designed for workloads", 0.4, None)])
    assert ids(promote.promote_hits(family, family, asked.withColumn("query", F.lit("for large memory jobs")), 1)) == ["A:1"]
    assert ids(promote.promote_hits(rows, rows, asked.withColumn("query", F.lit("anything")), 1)) == ["A:0"]


def test_gate(spark):
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = hits(spark, [("A", 0, "t", -2.0, None)])
    assert {r["query_id"]: r["refuse"] for r in promote.retrieval_gate(rows, asked).collect()} == {"q": True, "none": True}
    assert {r["query_id"]: r["refuse"] for r in promote.retrieval_gate(rows, asked, -5.0).collect()} == {"q": False, "none": True}


def test_scoped_search(spark):
    chunks = spark.createDataFrame([("a:0", "doc-a", 0, [1.0, 0.0]), ("b:0", "doc-b", 0, [0.0, 1.0])], "chunk_id string, document_id string, chunk_index int, vector array<double>")
    asked = spark.createDataFrame([("all", [1.0, 0.0], None), ("scoped", [1.0, 0.0], ["doc-b"])], "query_id string, vector array<double>, scope array<string>")
    got = {}
    for r in search.knn(asked, chunks, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["document_id"])
    assert got == {"all": ["doc-a", "doc-b"], "scoped": ["doc-b"]}


def test_unknown_scope(spark):
    registry = spark.createDataFrame([("a", "a.pdf")], "id string, filename string")
    asked = spark.createDataFrame([("x", ["a", "z"]), ("y", None)], "query_id string, scope array<string>")
    assert [tuple(r) for r in catalog.check_scope(asked, registry).collect()] == [("x", "z")]


def test_retrieve_end_to_end(spark):
    texts = ["the password can be reset on the account page", "prices of all plans", "how to reset a password: open the account page", "weather"]
    chunks = search.embed(spark.createDataFrame([(f"d:{i}", "d", "d.txt", i, None, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, filename string, chunk_index int, page int, text string"))
    asked = spark.createDataFrame([("q", "How do I reset my password?")], "query_id string, query string")
    got = retrieve.retrieve(asked, chunks, Params(top_k=2))
    assert set(ids(got)) == {"d:0", "d:2"}
    assert retrieve.retrieve(asked, chunks.where("false"), Params()).count() == 0


def test_fusion_keeps_best(spark):
    rows = spark.createDataFrame([("q", "a:0", "a", 0, 0.5), ("q", "a:0", "a", 0, 0.7), ("q", "b:0", "b", 0, 0.1)], "query_id string, chunk_id string, document_id string, chunk_index int, score double")
    assert [(r["rank"], r["chunk_id"], r["score"]) for r in search.fuse_variants(rows, 0.2).collect()] == [(1, "a:0", 0.7)]


def test_knn_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(f"{i % 7}:{i}", str(i % 7), i, [round(r.gauss(0, 1), 3) for _ in range(4)]) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(str(i), [r.gauss(0, 1) for _ in range(4)]) for i in range(9)], "query_id string, vector array<double>")
    got = {(x["query_id"], x["rank"]): x["chunk_id"] for x in search.knn(asked, chunks, 5).collect()}
    for q in asked.collect():
        best = sorted(rows, key=lambda c: (-round(float(np.dot(q["vector"], c[3])), 6), c[1], c[2]))[:5]
        assert [got[q["query_id"], k + 1] for k in range(5)] == [c[0] for c in best]


def test_more_terms_than_a_block(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(470))
    terms = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)} | {"0"}
    assert len(terms) > 100_000
    got = search.term_presence(spark.createDataFrame([(text,), (None,)], "text string"), spark.createDataFrame([(t,) for t in sorted(terms)], "term string"))
    assert {(x["chunks"], x["count"]) for x in got.groupBy("chunks").count().collect()} == {(1, len(terms) - 1), (0, 1)}


def test_blocks_of_queries_find_the_same(spark, sf_dir, monkeypatch):
    """More queries than a task holds are packed and joined: the hits are the same, scopes, own k and ties included."""
    chunks, asked = inputs.vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir).withColumn("n", (F.col("query_id").cast("int") % 7).cast("int"))
    chunks = chunks.unionByName(chunks.where("chunk_index % 3 = 0").withColumns({"chunk_id": F.concat("chunk_id", F.lit("b")), "chunk_index": F.col("chunk_index") + 9000}))
    found = []
    for block in (search.QUERY_BLOCK, 5):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        found.append(sorted(map(tuple, search.knn(asked, chunks, k_col="n", not_self=True).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) > 50


def test_groups_of_queries_meet_all_chunks(spark, sf_dir, monkeypatch):
    """Every group meets every chunk once, in several tasks though a task has few chunks, and is sent once a task, not beside each block."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "GROUP", 13)
    monkeypatch.setattr(search, "PACKED", 1)
    chunks = inputs.vectors(spark, sf_dir).repartition(8)
    asked = inputs.vector_queries(spark, sf_dir).select("query_id", "vector")

    def work(queries, batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for b in batches:
            ids = [(q, c) for c in b.column("chunk_id").to_pylist() for q in queries["query_id"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"q": [q for q, _ in ids], "c": [c for _, c in ids], "task": pa.array([task] * len(ids), pa.int32())})

    met = search.beside_queries(asked, chunks, work, "q string, c string, task int").collect()
    n, m = asked.count(), chunks.count()
    assert n > 13 and len({(r["q"], r["c"]) for r in met}) == len(met) == n * m
    tasks = {r["task"] for r in met}
    assert len(tasks) > -(-n // 13)  # not one task a group, as the chunks are in several parts
    rows = search._in_groups(asked, chunks.select(*search.IDS, "vector"), -(-n // 13)).select(F.col("q").isNotNull().alias("q")).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in rows} == {True: len(tasks), False: m * -(-n // 13) - len(tasks)}


def test_best_rows_equal_a_plain_sort(monkeypatch):
    """Rough scores only rule out: vectors of any length, many copies, scopes and own k give the rows of a full sort."""
    r = np.random.default_rng(3)
    vectors = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    for trial in range(20):
        n, m, d = int(r.integers(1, 40)), int(r.integers(1, 2500)), int(r.integers(2, 9))
        monkeypatch.setattr(search, "FIRST", int(r.integers(1, 300)))
        monkeypatch.setattr(search, "CELLS", int(r.integers(100, 100_000)))
        q, v, k = r.normal(size=(n, d)) * 10.0 ** r.integers(-3, 4), r.integers(-3, 4, (m, d)).astype(float), r.integers(0, 8, n)
        v = v[r.integers(0, min(m, 20), m)] if trial % 2 else v
        documents, index = [str(x) for x in r.integers(0, 30, m)], r.permutation(m).astype(np.int32)
        scopes = [sorted({str(x) for x in r.integers(0, 30, 3)}) if r.random() < 0.4 else None for _ in range(n)]
        table = pa.table({"query_id": pa.array(range(n)), "vector": vectors(q), "k": pa.array(k.astype(np.int32)), "scope": pa.array(scopes, pa.list_(pa.string()))})
        batch = pa.RecordBatch.from_arrays([pa.array(documents), pa.array(documents), pa.array(index), vectors(v)], names=["chunk_id", "document_id", "chunk_index", "vector"])
        held, step = search._Running(table, False), int(r.integers(1, m + 1))
        for i in range(0, m, step):
            held.add(batch.slice(i, step))
        got = sorted((x["query_id"], -x["score"], x["document_id"], x["chunk_index"]) for b in held.rows() for x in b.to_pylist())
        score = search.scores(q, v)
        want = [(i, *x) for i in range(n) for x in sorted((-score[i, j] / 10**6, documents[j], int(index[j])) for j in range(m) if scopes[i] is None or documents[j] in scopes[i])[: k[i]]]
        assert got == want


def test_term_presence_equals_brute_force(spark, monkeypatch):
    texts = ["The cat sat", "a CATALOGUE of cats", "", None, "dog", "Straße und straße"]
    terms = ["cat", "Cat", "", "at", "dog", "none", "straße", "c"]
    want = {t: sum(x is not None and t.lower() in x.lower() for x in texts) for t in terms}
    chunks, rows = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for block in (terms_module.TERM_BLOCK, 2):
        monkeypatch.setattr(terms_module, "TERM_BLOCK", block)
        assert {r["term"]: r["chunks"] for r in search.term_presence(chunks, rows).collect()} == want


def test_top_k_leaves_a_task_once(spark):
    """However many Arrow batches there are, a task sends its best k rows per query, without the texts and vectors."""
    r = random.Random(9)
    rows = [(f"c{i}", f"d{i % 50}", i, [round(r.gauss(0, 1), 1) for _ in range(3)], f"text {i}") for i in range(4000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, vector array<double>, text string").repartition(2)
    asked = spark.createDataFrame([(str(i), [r.gauss(0, 1) for _ in range(3)]) for i in range(7)], "query_id string, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        sent = search.beside_queries(asked.withColumn("k", F.lit(5)), chunks.select("chunk_id", "document_id", "chunk_index", "vector"), lambda t, b: search._best(t, b, False), "query_id string, k int, chunk_id string, document_id string, chunk_index int, score double")
        assert sent.count() == 2 * 7 * 5
        got = {}
        for x in search.knn(asked, chunks, 5, keep=("text", "vector")).collect():
            got[x["query_id"], x["rank"]] = (x["chunk_id"], x["text"], x["vector"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for q in asked.collect():
        best = sorted(rows, key=lambda c: (-round(float(np.dot(q["vector"], c[3])), 6), c[1], c[2]))[:5]
        assert [got[q["query_id"], k + 1] for k in range(5)] == [(c[0], c[4], c[3]) for c in best]


def test_repeated_chunk_names(spark):
    """Rows that share all ids are hits of their own, and do not multiply where columns are fetched."""
    chunks = spark.createDataFrame([("a", "d", 0, [1.0], "x"), ("a", "d", 0, [1.0], "x"), (None, None, None, [0.5], "y")], "chunk_id string, document_id string, chunk_index int, vector array<double>, text string")
    got = search.knn(spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>"), chunks, 9, keep=("text",))
    assert [(r["rank"], r["chunk_id"], r["text"]) for r in got.orderBy("rank").collect()] == [(1, "a", "x"), (2, "a", "x"), (3, None, "y")]
    assert search.knn(spark.createDataFrame([], "query_id string, vector array<double>"), chunks, 9, keep=("text",)).count() == 0


def test_encoders_see_the_text(spark):
    """Untouched, with the prefix in front of queries, in portions of texts of like length, and one encoder a worker."""
    texts = ["Hello, World! C++ is-not C#.", "", None, "x" * 90, "y" * 80, "ab"] * 10

    def seeing(dim):
        made = [0]

        def encode(column):
            assert isinstance(column, pa.Array) and len(column) <= 4
            made[0] += 1
            size = [len(t) for t in column.to_pylist()]
            return np.array([[t.count("+"), t.count(">"), len(t), max(size) - min(size)] for t in column.to_pylist()], float) / np.array([[1, 1, 1, 1000]])

        return encode

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = {r["i"]: r["vector"] for r in encode.embed(df, encoder=seeing, dim=4, rows=4).collect()}
    for i, t in enumerate(texts):
        raw = np.array(got[i])
        n = len(t or "")
        assert n == 0 or abs(raw[0] / raw[2] - (t.count("+") / n)) < 1e-9
    asked = encode.embed_queries(df.where("i = 0"), "text", lambda dim: (lambda c: np.array([[t.startswith("> Hello, World! C++"), 0.0] for t in c.to_pylist()], float)), prefix="> ", dim=2)
    assert asked.first()["vector"] == [1.0, 0.0]


def test_hash_encoder_equals_plain_words():
    r = random.Random(5)
    texts = ["", None, "Ünïcödé — wörds…  and_under 12½ x²", "a\u0301b", "日本語 テスト", "—", "ÀÉ ß ÿ", "🙂 ok🙂ok", *("".join(r.choice("ab é—\n_1,") for _ in range(r.randint(0, 40))) for _ in range(200))]
    got = encode.hash_encoder(16)(pa.array(texts))
    import regex

    for t, v in zip(texts, got):
        want = np.zeros(16)
        for w in regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower()):
            d = hashlib.md5(w.encode()).hexdigest()
            want[int(d[:8], 16) % 16] += 1 - 2 * (int(d[8], 16) % 2)
        assert (v == want).all(), t


def test_term_index_equals_brute_force(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["", "prefix-shared-one", "xprefix-shared-two"]
    listed = sorted({t[i : i + n] for t in texts for n in (1, 2, 7, 8, 9, 15, 16, 17, 40) for i in (0, 3, 11) if len(t[i : i + n]) == n} | {"zz", "prefix-shared-one!", "prefix-shared-"})
    index = terms_module.TermIndex(listed)
    for pairs in (1, 1 << 21):
        monkeypatch.setattr(terms_module, "PAIRS", pairs)
        term, row = index.find(*spans.bytes_of(pa.array(texts)))
        assert set(zip(term.tolist(), row.tolist())) == {(i, j) for i, t in enumerate(listed) for j, x in enumerate(texts) if t in x}
    monkeypatch.setattr(terms_module, "SLICE", 50)
    assert [x for _, c in terms_module.text_slices(pa.array(texts)) for x in c.to_pylist()] == texts


def test_rank_of_keyword_equals_brute_force(spark, monkeypatch):
    r = random.Random(11)
    words = ["red", "Green", "blue", "grey", ""]
    rows = [(f"c{i}", f"d{r.randint(0, 5)}", i, [float(r.randint(-2, 2)) for _ in range(3)], r.choice([None, " ".join(r.choice(words) for _ in range(2))])) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, vector array<double>, text string").repartition(3)
    asked = [(f"q{i}", [r.gauss(0, 1) for _ in range(3)], r.choice(["RED", "green", "lilac", "e", "", None])) for i in range(25)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>, keyword string")
    for depth, block in ((1000, 8192), (3, 8192), (3, 4)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = {x["query_id"]: x["first_rank"] for x in search.dense_rank_of_keyword(queries, chunks, depth).collect()}
        for q, v, w in asked:
            best = sorted(rows, key=lambda c: (-round(float(np.dot(v, c[3])), 6), c[1], c[2]))
            at = [i + 1 for i, c in enumerate(best) if w is not None and c[4] is not None and w.lower() in c[4].lower()]
            assert got[q] == (None if not at else at[0] if at[0] <= depth else -1)
