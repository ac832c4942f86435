"""Running numbers against plain sorting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ragtables.operators.numbering import numbered



def test_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = {(a.g, a.x, a.i): (a.n, a.before) for a in numbered(df, [F.desc("x"), F.asc("i")], within=("g",), name="n", sums={"before": "x"}).collect()}
    for g in {x[0] for x in rows}:
        held = 0
        for n, (x, i) in enumerate(sorted(((x, i) for h, x, i in rows if h == g), key=lambda p: (-p[0], p[1]))):
            assert got[g, x, i] == (n, held)
            held += x
    assert numbered(df.limit(0), [F.asc("x")]).count() == 0


def test_chunks_of_repeated_pages(spark):
    """Rows of one (document, page), null pages and equal rows are each numbered once, in the same way however they lie."""
    from ragtables.operators import chunking
    from ragtables.plans.ingest import ingest

    rows = [("d", "f.txt", None, "First text here."), ("d", "f.txt", None, "Other text here."), ("d", "f.txt", 2, "Page two. " * 60), ("d", "f.txt", 0, "Nought."), ("d", "f.txt", None, "First text here."), ("e", "g.txt", 1, "Alone."), (None, "h.txt", 1, "Nameless."), (None, "h.txt", 1, "Nameless too.")]
    schema = "document_id string, filename string, page int, text string"
    seen = []
    for parts in (1, 5):
        packed = chunking.chunk_pages(spark.createDataFrame(rows, schema).repartition(parts), 200, 40)
        got = chunking.number_chunks(packed).collect()
        assert len(got) == sum(len(r["chunks"]) for r in packed.collect())
        for d in ("d", "e", None):
            mine = sorted((r["chunk_index"], r["page"] or 0) for r in got if r["document_id"] == d)
            assert [i for i, _ in mine] == list(range(len(mine))) and [p for _, p in mine] == sorted(p for _, p in mine)
        seen.append(sorted(map(tuple, got), key=repr))
    assert seen[0] == seen[1]
    chunks, registry, _ = ingest(spark.createDataFrame(rows, schema).where("document_id is not null"))
    ids = [r["chunk_id"] for r in chunks.collect()]
    assert len(ids) == len(set(ids)) and {r["text"] for r in chunks.where("page is null").collect()} == {"First text here.", "Other text here."}


def test_a_hot_document_is_many_tasks(spark):
    """A document with most of all pages is dealt to ranges: no task numbers more than its share."""
    from ragtables.operators import chunking

    df = spark.range(8000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")).alias("document_id"), F.lit("f").alias("filename"), F.col("id").cast("int").alias("page"), F.array(F.lit("a"), F.lit("b")).alias("chunks"))
    rows = df.select("document_id", "page", F.lit(2).cast("long").alias("n"))
    got = numbered(rows, [F.asc("page")], within=("document_id",), sums={"start": "n"}).where("document_id = 'hot'")
    assert got.where("start <> 2 * number").count() == 0 and got.count() == 5600
    spread = rows.repartitionByRange(4, "document_id", "page").groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < 4000
    assert chunking.number_chunks(df).where("document_id = 'hot'").agg(F.max("chunk_index"), F.count("*")).first()[:] == (11199, 11200)
