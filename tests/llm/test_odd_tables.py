"""Every operator and the pipeline on the odd tables: none crashes, and rows and columns come out as stated."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragtables.llm import lm, multiindex, neardup, outliers, packing, pieces, sitequality, substrings, toxicity

KINDS = ["odd", "empty", "one short", "only nulls", "no words", "repeated", "short partition"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(30)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def plain_cut(rows, length=13):
    """(id, words left) of each row with an id, windows judged on the input."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        if i is not None:
            for k in range(len(ws) - length + 1):
                first[tuple(ws[k : k + length])] = min(i, first.get(tuple(ws[k : k + length]), i))
    out = []
    for i, ws in split:
        gone = {k + j for k in range(len(ws) - length + 1) if i is not None and first[tuple(ws[k : k + length])] < i for j in range(length)}
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", KINDS)
def test_substrings(spark, tables, kind):
    docs = tables[kind]
    cut = substrings.remove_repeats(docs, counts=("before", "gone"))
    assert cut.columns == [*docs.columns, "before", "gone"]
    got = sorted(((r["doc_id"], r["before"], r["gone"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in cut.collect()), key=repr)
    assert got == plain_cut([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("kind", ["only nulls", "short partition", "repeated"])
def test_operators_hold(spark, tables, labels, kind):
    docs = tables[kind]
    n, ids = docs.count(), docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert lm.score_documents(docs, F.col("doc_id") % 3 != 0).count() == n
    assert outliers.quality_rules(docs).count() == n
    assert packing.pack_documents(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert toxicity.toxic_documents(docs, labels).where("score is null").count() == 0
    assert neardup.near_duplicates(docs).select("doc_id").distinct().count() >= ids
    assert pieces.encode(docs).count() == n
    assert sitequality.site_quality(docs, labels).where("score between 0 and 1").count() == n


@pytest.mark.parametrize("kind", ["odd", "empty", "only nulls", "short partition"])
def test_pipeline(spark, tables, labels, kind):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tables[kind].write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    good = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})  # so that most rows come to the last stages
    good.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == before.columns, name
        if name == "substring dedup":
            assert docs.drop("text", "n_chars").exceptAll(before.drop("text", "n_chars")).count() == 0, name
        else:
            assert docs.exceptAll(before).count() == 0, name  # rows go or stay, nothing else
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    if kind == "odd":
        assert packed.count() > 0 and corpus_pipeline.run(spark, folder).count() > 0


def test_few_vectors(spark):
    """All candidates where there are fewer than ten, at the default share, also if rows share an id."""
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 11, 13, 15):
        for own in (1, 2):
            rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(n)] + [(0, [float(x) for x in r.normal(size=6)]) for _ in range(own - 1)]
            df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
            got = multiindex.neighbours(df, F.col("id") == 0).groupBy("query_id", "rank").count().count()
            assert got == min(10, own * (n - 1)), (n, own)


def test_crowded_cell(spark):
    """A vector that a third of all rows repeat fills many blocks, and each meets each block of queries once."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(600)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(600, 1900)]
    got = multiindex.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, share=1.0).collect()
    fine = {i: np.array(v) for i, v in rows}
    assert len(got) == 19 * 10
    for q in (0, 700):
        best = sorted((float(np.sqrt(((fine[q] - v) ** 2).sum())), i) for i, v in fine.items() if i != q)[:10]
        assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [i for _, i in best]


def plain_strength(groups):
    """groups: (values, centre) each; noise within over variance between, by moments."""
    noise = sum(((x - x.mean()) ** 2).sum() for x, _ in groups) / max(sum(len(x) - 1 for x, _ in groups), 1)
    n = np.array([len(x) for x, _ in groups], float)
    between = sum(len(x) * (x.mean() - c) ** 2 for x, c in groups) - noise * (len(groups) - 1)
    between /= max(n.sum() - (n * n).sum() / n.sum(), 1)
    return min(max(noise / max(between, 1e-9), 1.0), 1e6)


@pytest.mark.parametrize("kind", ["odd", "repeated"])
def test_site_posteriors_equal_a_plain_loop(spark, tables, labels, kind):
    """Posteriors of hosts and of their paths, and the score of each row, from the rows' own evidence."""
    docs = tables[kind].drop("id").withColumn("key_", F.monotonically_increasing_id())
    judged = {}
    for r in sitequality._judged(docs, labels.withColumnRenamed("doc_id", "key_"), "key_", "text", "source", "lang").collect():
        judged[r["__id"]] = r
    rows = [(r["key_"], r["source"], r["lang"]) for r in docs.collect()]
    p = {k: judged[k]["p"] for k, _, _ in rows}
    prior = float(np.mean(list(p.values())))
    hosts = {h: np.array([p[k] for k, s, _ in rows if s == h]) for _, h, _ in rows}
    k1 = plain_strength([(x, prior) for x in hosts.values()])
    host = {h: (x.sum() + k1 * prior) / (len(x) + k1) for h, x in hosts.items()}
    paths = {(h, g): np.array([p[k] for k, s, t in rows if (s, t) == (h, g)]) for _, h, g in rows}
    k2 = plain_strength([(x, host[h]) for (h, _), x in paths.items()])
    logit = lambda v: np.log(v / (1 - v))
    for k, h, g in rows:
        x = paths[h, g]
        mean = (x.sum() + k2 * host[h]) / (len(x) + k2)
        want = 1 / (1 + np.exp(-(logit(p[k]) + logit(mean) - logit(prior))))
        got = judged[k]
        assert np.allclose([got["host_mean"], got["path_mean"], got["score"]], [host[h], mean, want], atol=1e-9)
        assert got["predicted"] == int(want >= sitequality.THRESHOLD)
