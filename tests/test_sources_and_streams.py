from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ragtables.params import Params
from ragtables.plans.ingest import chunk_table
from ragtables.queries import inputs
from ragtables.operators import memory, search
from ragtables.sources import files, tables
from ragtables.sources.store import ChunkStore
from ragtables.streaming import ingest as stream_ingest
from ragtables.streaming.memory import remember


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_text_files(spark):
    d = folder()
    for name, data in (("a.TXT", b"caf\xc3\xa9 \xff!\xef\xbf\xbd\xe2\x82 \xef\xb7\x90b"), ("b.md", b"# x"), ("c.pdf", b"%PDF")):
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    got = {r["filename"]: r["text"] for r in files.read_text_documents(spark, d).collect()}
    assert got == {"a.TXT": "café !\ufffd \ufdd0b", "b.md": "# x"}
    paged = files.read_pages(spark.read.format("binaryFile").load(f"{d}/b.md"), lambda b: [b.decode(), None])
    assert [(r["page"], r["text"]) for r in paged.orderBy("page").collect()] == [(1, "# x"), (2, "")]


def test_eval_files(spark):
    d = folder()
    with open(f"{d}/set.json", "w") as f:
        json.dump({"name": "s", "cases": [{"id": "1", "query": "q"}, {"id": "2", "query": "r", "should_refuse": True, "top_k": 5}]}, f)
    cases = files.read_eval_dataset(spark, f"{d}/set.json").orderBy("position").collect()
    assert [c["should_refuse"] for c in cases] == [False, True] and cases[0]["relevant_keywords"] == [] and cases[0]["mode"] == "auto" and cases[1]["top_k"] == 5
    report = spark.createDataFrame([("s", 1.0)], "dataset string, precision_at_k double")
    files.write_report(report, spark.createDataFrame([("2", 0.0), ("1", 1.0)], "case_id string, precision_at_k double"), f"{d}/report")
    back = spark.read.json(f"{d}/report").first()
    assert [c["case_id"] for c in back["cases"]] == ["1", "2"]


def test_chunk_tables(spark, sf_dir):
    rows = inputs.embedded_lines(spark, sf_dir)
    path = folder() + "/chunks"
    tables.write_chunks(rows, path)
    assert tables.read_chunks(spark, path).count() == rows.count()


def test_streamed_ingest_equals_batch(spark, sf_dir):
    source, out = folder(), folder()
    pages = inputs.pages(spark, sf_dir).where("filename like '%.txt'")
    pages.repartition(3).write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_ingest.start_ingest(stream, out, folder(), Params()).awaitTermination()
    got = {(r["chunk_id"], r["text"]) for r in ChunkStore(spark, out).chunks().select("chunk_id", "text").collect()}
    want = {(r["chunk_id"], r["text"]) for r in chunk_table(pages).select("chunk_id", "text").collect()}
    assert got == want
    assert ChunkStore(spark, out).registry().count() == pages.select("document_id").distinct().count() - ChunkStore(spark, out).rejects().count()


def test_documents_that_come_again(spark):
    """The later batch stands, also where it rejects the document; compaction and a batch that is run again change nothing."""
    source, out, marks = folder(), folder(), folder()
    schema = "document_id string, filename string, page int, text string"

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_ingest.start_ingest(stream, out, marks, Params(), compact_every=4).awaitTermination()

    def held():
        return {(r["document_id"], r["text"]) for r in ChunkStore(spark, out).chunks().collect()}

    send(("a", "a.txt", None, "First."), ("b", "b.txt", None, "Second."))
    send(("a", "a.txt", None, "Other."), ("c", "c.txt", None, "Third."))
    assert held() == {("a", "Other."), ("b", "Second."), ("c", "Third.")}
    send(("b", "b.txt", None, " "))
    store = ChunkStore(spark, out)
    assert held() == {("a", "Other."), ("c", "Third.")} and {r["document_id"] for r in store.rejects().collect()} == {"b"}
    assert sorted(r["id"] for r in store.registry().collect()) == ["a", "c"]
    assert not store.append(store.chunks().limit(0), store.registry().limit(0), batch=2)
    send(("d", "d.txt", None, "Fourth."))  # the fourth batch compacts
    assert max(len({e["seq"] for e in store.entries() if e["bucket"] == b}) for b in range(64)) == 1
    assert held() == {("a", "Other."), ("c", "Third."), ("d", "Fourth.")}


def test_store_changes_touched_buckets_only(spark, monkeypatch):
    rows = [(f"d{i}:0", f"d{i}", f"f{i % 40}.txt", 0, None, f"text {i}", [float(i), 1.0]) for i in range(200)]
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    registry = chunks.select(F.col("document_id").alias("id"), "filename")
    store = ChunkStore(spark, folder() + "/corpus")
    assert store.chunks().count() == 0
    store.append(chunks, registry)

    def files_of():
        got = {}
        for f in store.chunks().inputFiles():
            got.setdefault(f.split("/bucket=")[1].split("/")[0], set()).add(f)
        return got

    before, ids = files_of(), spark.createDataFrame([("d7",), ("nobody",), (None,)], "document_id string")
    touched = {str(b) for b in store.buckets_of(ids)}
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        try:
            store.delete(ids)
        except RuntimeError:
            pass
    assert files_of() == before and store.chunks().count() == 200  # staged, never swapped
    store.delete(ids)
    after = files_of()
    assert {b for b in before if before[b] != after.get(b)} <= touched and store.chunks().count() == 199 and store.registry().count() == 199
    new = spark.createDataFrame([("n:0", "n", "f3.txt", 0, None, "new", None)], tables.CHUNKS)
    store.replace(new, new.select(F.col("document_id").alias("id"), "filename"))
    assert {r["document_id"] for r in store.chunks().collect()} == {f"d{i}" for i in range(200) if i != 7 and i % 40 != 3} | {"n"}
    assert store.registry().where("filename = 'f3.txt'").count() == 1


def test_scoped_reads_take_few_buckets(spark):
    rows = [(f"d{i}:0", f"d{i}", "f", 0, None, "t", [float(i % 7), 1.0]) for i in range(300)]
    store = ChunkStore(spark, folder() + "/corpus")
    chunks = spark.createDataFrame(rows, tables.CHUNKS)
    store.append(chunks, chunks.select(F.col("document_id").alias("id")))
    asked = spark.createDataFrame([("x", [1.0, 0.0], ["d5"]), ("y", [1.0, 0.0], ["d5", "d6", "d9"])], "query_id string, vector array<double>, scope array<string>")
    one = store.chunks(scopes=asked.where("query_id = 'x'"))
    assert len({f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pruned, whole = (sorted(map(tuple, search.knn(asked, c, 3).collect())) for c in (store.chunks(scopes=asked), chunks))
    assert pruned == whole and len(pruned) == 4
    free = asked.union(spark.createDataFrame([("z", [0.0, 1.0], None)], asked.schema))
    assert sorted(map(tuple, search.knn(free, store.chunks(scopes=free), 3).collect())) == sorted(map(tuple, search.knn(free, chunks, 3).collect()))


def test_streamed_memory_equals_batch(spark, sf_dir):
    source = folder()
    turns = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for part in range(3):  # in order of turns
        turns.where(F.least(F.floor(F.col("turn") / 3), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = remember(stream, 4).writeStream.format("memory").queryName("remembered").outputMode("append").option("checkpointLocation", folder()).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["conv_id"], r["turn"]): (r["standalone"], r["needs_context"], len(r["history"])) for r in spark.table("remembered").collect()}
    want = memory.contextualize(memory.recent_turns(memory.dialogue(turns), 4), 4)
    assert got == {(r["conv_id"], r["turn"]): (r["standalone"], r["needs_context"], len(r["history"])) for r in want.collect()}


def heard(spark, rows, parts, n):
    """rows (conv_id, turn, role, text) dealt to so many batches of a stream; what came out, and how many rows."""
    source, marks, out = folder(), folder(), folder()
    schema = "conv_id long, turn long, role string, text string"
    for part in range(parts):
        spark.createDataFrame(rows[part::parts], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        remember(stream, n).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("conv_id long, turn long, standalone string, needs_context boolean, history array<struct<turn:bigint,role:string,text:string>>").parquet(out).collect()
    return {(r["conv_id"], r["turn"]): (r["standalone"], r["needs_context"], [tuple(t) for t in r["history"]]) for r in got}, len(got)


def test_turns_out_of_order(spark):
    """Turns that come early wait over batches, repeated ones are passed over: the result is that of the batch."""
    import random

    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "user"]), r.choice(["tell me about the price of it", "zones", "", None])) for c in range(4) for t in range(12)]
    mixed = rows[:]
    r.shuffle(mixed)
    got, n = heard(spark, mixed + mixed[:9], 3, 3)
    turns = memory.dialogue(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = memory.contextualize(memory.recent_turns(turns, 3), 3).collect()
    assert n == len(want) and got == {(x["conv_id"], x["turn"]): (x["standalone"], x["needs_context"], [tuple(t) for t in x["history"]]) for x in want}


def test_long_thread_in_one_batch(spark):
    """A thread of many messages goes through the state by portions, and backwards through the waiting ones."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"message {t}") for t in range(30_000)]
    got, n = heard(spark, rows, 1, 2)
    assert n == 15_000 and got[1, 29_998][2] == [(29_996, "user", "message 29996"), (29_997, "assistant", "message 29997")]


def test_streamed_checks_equal_batch(spark):
    """Hits in other batches than their answers, hits that come too late, and answers without any."""
    from ragtables.operators import validate
    from ragtables.params import REFUSAL
    from ragtables.streaming.validation import check_answers

    said, found, out, marks = (folder() for _ in range(4))
    text = "Instances have four virtual processors and memory."
    answers = "query_id string, answer string, sent_at timestamp"
    hits = "query_id string, texts array<string>, best double, found_at timestamp"
    t = lambda s: f"2024-01-01 00:{s:02d}:00"

    def send(a, h):
        cast = lambda rows, schema, at: spark.createDataFrame(rows, schema.replace(f"{at} timestamp", f"{at} string")).withColumn(at, F.to_timestamp(at))
        cast(a, answers, "sent_at").coalesce(1).write.mode("append").parquet(said)
        cast(h, hits, "found_at").coalesce(1).write.mode("append").parquet(found)
        streams = (spark.readStream.schema(s).parquet(p) for s, p in ((answers, said), (hits, found)))
        check_answers(*streams, wait="5 minutes", delay="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return {r["query_id"]: (r["answer"], r["grounded"]) for r in spark.read.schema("query_id string, answer string, grounded boolean").parquet(out).collect() if r["query_id"][0] != "-"}

    ok = "Instances have four processors [1]."
    got = send([("a", ok, t(1)), ("b", ok, t(1)), ("late", ok, t(1)), ("bad", "x [9].", t(1))], [("b", [text], 1.0, t(1)), ("low", [text], 1.0, t(1))])
    assert set(got) == {"b"}
    got = send([("low", ok, t(2))], [("a", [text], 1.0, t(3)), ("bad", [text], 1.0, t(2))])
    assert set(got) == {"a", "b", "bad", "low"}
    send([("-x", "", t(40))], [("-x", [text], 1.0, t(40))])
    got = send([("-y", "", t(41))], [("late", [text], 1.0, t(2)), ("-y", [text], 1.0, t(41))])
    assert got["late"] == (REFUSAL, False) and len(got) == 5
    checked = validate.apply_validation(validate.validated(spark.createDataFrame([(q, a, [text]) for q, a in (("a", ok), ("b", ok), ("low", ok), ("bad", "x [9]."))], "query_id string, answer string, texts array<string>")))
    assert {r["query_id"]: (r["answer"], r["grounded"]) for r in checked.collect()} == {k: v for k, v in got.items() if k != "late"}
