from __future__ import annotations

import time

from pyspark.sql import functions as F

from ragtables.functions.citations import citation_groups
from ragtables.operators import context, evaluate, memory, validate
from ragtables.params import DISCLAIMER, REFUSAL, Params
from ragtables.plans import answer, converse, evaluation, ingest
from ragtables.sources.files import CASE, with_case_defaults
from tests.test_search_and_selection import hits


def first_line(s):
    return s.split("\n")[0]


def test_citation_groups(spark):
    def groups(a):
        row = spark.createDataFrame([(a,)], "a string").select(citation_groups(F.col("a")).alias("g")).first()
        return [(g["claim"], list(g["markers"])) for g in row["g"]]

    assert groups("claim one [1][2][3] next thing [4]") == [("claim one ", [1]), ("[2]", [3]), (" next thing ", [4])]
    assert groups("a\nb [2, 4]") == [("b ", [2, 4])]
    assert groups("none") == []


def checked(spark, text, passages, **k):
    rows = spark.createDataFrame([("q", text, passages)], "query_id string, answer string, texts array<string>")
    return validate.validated(rows, **k).first()


def test_validation(spark):
    p = ["Instances have four virtual processors and memory."]
    r = checked(spark, "Instances have four processors [1].", p)
    assert r["passed"] and r["support"] == 1.0 and r["notes"] == []
    r = checked(spark, "Instances [1] have processors [5].", p)
    assert not r["passed"] and r["invalid_markers"] == [5] and "[5]" in r["notes"][0]
    r = checked(spark, "Instances have processors [1]. Bananas grow yellow [1].", p, min_support=0.75)
    assert not r["passed"] and r["support"] == 0.5 and "50%" in r["notes"][0]
    assert not checked(spark, "one two three four five six seven eight nine ten eleven twelve thirteen", p)["passed"]
    assert checked(spark, "short answer", p)["passed"]
    assert checked(spark, "Instances have processors and memory [1, 2].", p + ["Memory is large."])["support"] == 1.0
    out = validate.apply_validation(validate.validated(spark.createDataFrame([("q", "x [9].", p)], "query_id string, answer string, texts array<string>"))).first()
    assert out["answer"] == "x [9]." + DISCLAIMER and not out["grounded"]


def test_grouping_and_context(spark):
    rows = hits(spark, [("A", 2, "third", 3, None), ("B", 0, "other", 2, None), ("A", 0, "first", 1, None)])
    got = [(r["document_id"], r["chunk_index"], r["marker"]) for r in context.group_hits(rows).orderBy("marker").collect()]
    assert got == [("A", 0, 1), ("A", 2, 2), ("B", 0, 3)]
    text = context.build_grouped_context(rows).first()["context"]
    assert text == "### Source: A.pdf\n[1] (chunk 0)\nfirst\n[2] (chunk 2)\nthird\n\n### Source: B.pdf\n[3] (chunk 0)\nother"
    assert context.build_flat_context(rows).first()["context"].startswith("[1] (source: A.pdf)\nthird\n\n[2]")


def test_overlap(spark):
    shared = "This sentence stands at the boundary of both chunks."
    rows = hits(spark, [("A", 0, f"Start here. {shared}", 3, None), ("A", 1, f"{shared} And then more.", 2, None)])
    shown = [r["shown"] for r in context.trim_overlap(context.group_hits(rows)).orderBy("marker").collect()]
    assert shown == [f"Start here. {shared}", "And then more."]
    same = hits(spark, [("A", 0, "Just this.", 3, None), ("A", 1, "just  THIS.", 2, None)])
    assert "(See preceding passage [1] for full text.)" in context.build_grouped_context(same).first()["context"]
    assert context._behind("x" * 10 + "y" * 50, "y" * 50 + " tail") == "tail"
    assert context._behind("abc", "abc") == "abc"


def test_boundary_equals_plain_search():
    import random

    r = random.Random(1)
    for _ in range(200):
        p = "".join(r.choice("ab") for _ in range(r.randint(0, 120)))
        c = (p[-r.randint(1, 90) :] if p else "") + "".join(r.choice("ab") for _ in range(r.randint(0, 30)))
        want = c
        for size in range(min(len(p), len(c), 600), 39, -1):
            if p[-size:] == c[:size]:
                want = c[size:].lstrip() or c
                break
        assert context._behind(p, c) == want


def test_extractive_and_fallback(spark):
    prompts = spark.createDataFrame([("q", "CONTEXT:\nthe passage\n\nQUESTION: what?", "openai")], "query_id string, prompt string, primary string")
    assert context.extractive_answer(prompts).first()["answer"].endswith("the passage")
    done = spark.createDataFrame([("q", "openai", None), ("q", "ollama", "local")], "query_id string, provider string, answer string")
    assert tuple(context.select_answer(prompts, done).first()) == ("q", "local", "ollama")
    r = context.select_answer(prompts, done.where("provider = 'openai'")).first()
    assert r["provider"] == "extractive" and "'openai'" in r["answer"]


def test_answer_plan(spark):
    rows = hits(spark, [("A", 0, "Paris is the capital of France.", 0.9, None)])
    queries = spark.createDataFrame([("q", "capital?"), ("none", "x")], "query_id string, query string")
    done = spark.createDataFrame([("q", "openai", "Berlin was nowhere mentioned [3].")], "query_id string, provider string, answer string")
    got = {r["query_id"]: r for r in answer.answer(queries, rows, done, primary="openai").collect()}
    assert got["none"]["answer"] == REFUSAL and got["none"]["provider"] == "none" and not got["none"]["grounded"]
    assert got["q"]["answer"].endswith(DISCLAIMER) and not got["q"]["grounded"]


def metrics(spark, answers, rows, **case):
    base = {"id": "q", "query": "x", "relevant_keywords": [], "expected_answer_keywords": [], "forbidden_answer_keywords": [], "should_refuse": False, "expected_source_filenames": []} | case
    schema = "id string, query string, relevant_keywords array<string>, expected_answer_keywords array<string>, forbidden_answer_keywords array<string>, should_refuse boolean, expected_source_filenames array<string>"
    cases = spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)
    return evaluate.score_cases(cases, spark.createDataFrame([("q", answers)], "query_id string, answer string"), rows).first()


def test_metrics(spark):
    rows = hits(spark, [("doc", 0, "Within 14 days.", 0.8, None), ("doc", 1, "Nothing.", 0.7, None)])
    m = metrics(spark, "In 14 days [1].", rows, relevant_keywords=["14 days", "18 days"], expected_source_filenames=["doc.pdf"])
    assert (m["precision_at_k"], m["recall_at_k"], m["source_accuracy"], m["hallucination"]) == (0.5, 0.5, 1.0, False)
    assert metrics(spark, "It takes 99 days.", rows)["hallucination"]
    assert not metrics(spark, "It began in 2019 [1, 2].", rows)["hallucination"]
    assert metrics(spark, REFUSAL, rows, should_refuse=True)["refused_correctly"]
    assert metrics(spark, "an answer", rows, should_refuse=True)["hallucination"]
    assert metrics(spark, "x", rows, forbidden_answer_keywords=["X"])["hallucination"]
    assert metrics(spark, "x", rows, expected_source_filenames=["else.pdf"])["source_accuracy"] == 0.0


def test_report(spark):
    m = spark.createDataFrame([("a", 1.0, 1.0, False, 1.0, 1.0, True, 1, 1, 1.0, 0.2), ("r", 0.0, 0.0, True, 1.0, 0.0, False, 0, 1, 1.0, 0.4)], "case_id string, precision_at_k double, recall_at_k double, hallucination boolean, citation_accuracy double, answer_keyword_recall double, refused_correctly boolean, retrieved_relevant int, retrieved_total int, source_accuracy double, redundancy double")
    cases = spark.createDataFrame([("a", False), ("r", True)], "id string, should_refuse boolean")
    r = evaluate.build_report(m, cases).first()
    assert (r["num_cases"], r["precision_at_k"], r["hallucination_rate"], r["refusal_accuracy"]) == (2, 0.5, 0.5, 0.0)
    assert evaluate.build_report(m, cases.where("not should_refuse")).first()["refusal_accuracy"] == 1.0
    kept, report = evaluate.merge_reports(m, m.where("case_id = 'a'").withColumn("precision_at_k", F.lit(0.0)), cases)
    assert kept.count() == 2 and report.first()["precision_at_k"] == 0.0


def turns(spark, rows):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")


def test_memory(spark):
    rows = turns(spark, [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "what about it?")])
    state = memory.conversation_state(rows.where("turn < 4"), 4).first()
    assert [t["text"] for t in state["turns"]][-2:] == ["q2", "a2"]
    last = memory.contextualize(rows).orderBy(F.desc("turn")).first()
    assert last["needs_context"] and last["standalone"] == "q2 — follow-up: what about it?"
    alone = memory.contextualize(turns(spark, [("user", "x"), ("assistant", "y"), ("user", "please list every region of the service by name")])).orderBy(F.desc("turn")).first()
    assert not alone["needs_context"]
    prompts = spark.createDataFrame([("q", "p")], "query_id string, prompt string")
    history = spark.createDataFrame([("q", [("user", "a"), ("assistant", "b")])], "query_id string, history array<struct<role:string,content:string>>")
    assert [m["role"] for m in context.build_messages(prompts, history).first()["messages"]] == ["system", "user", "assistant", "user"]


def test_citation_groups_take_one_pass(spark):
    """A text without marks, and one behind its last mark, is not searched from every place."""
    long = "some words " * 100_000
    rows = [("none", long), ("late", "first [1] " + long), ("quirk", "claim one [1][2][3] next thing [4] rest"), ("bare", "[1]"), ("grouped", "x\ny [ 1 , 20 ]"), ("open", "a [1, b [2"), ("empty", ""), ("null", None)]
    began = time.time()
    got = {r["id"]: r["g"] and [(g["claim"], g["markers"]) for g in r["g"]] for r in spark.createDataFrame(rows, "id string, t string").select("id", citation_groups(F.col("t")).alias("g")).collect()}
    assert time.time() - began < 20
    assert got["none"] == [] and got["late"] == [("first ", [1])] and got["quirk"] == [("claim one ", [1]), ("[2]", [3]), (" next thing ", [4])]
    assert got["bare"] == got["open"] == got["empty"] == [] and got["grouped"] == [("y ", [1, 20])] and got["null"] is None


def small_corpus(spark):
    rows = [("1", "regions.txt", None, "Every region holds three availability zones. Zones are isolated buildings."), ("2", "prices.txt", None, "A reserved price lasts one year. Reserved prices are paid monthly.")]
    chunks, registry, _ = ingest.ingest(spark.createDataFrame(rows, "document_id string, filename string, page int, text string"))
    return chunks.cache(), registry.withColumn("uploaded_at", F.lit(1))


def test_evaluation_run(spark):
    """Scope, retrieval, answer, metrics, notes and report of a whole set."""
    chunks, registry = small_corpus(spark)
    none = []
    rows = [
        ("zones", "How many availability zones has a region?", ["three"], ["three"], none, False, none, ["regions.txt"], None, None),
        ("scoped", "How many availability zones has a region?", ["three"], none, none, False, ["prices.txt"], ["regions.txt"], 1, None),
        ("refuse", "xylophone quartz", none, none, none, True, None, none, None, None),
        ("lost", "anything", none, none, none, False, ["gone.txt"], none, None, None),
        ("remote", "How long does a reserved price last?", ["one year"], ["one year"], ["ten"], False, none, none, 1, "openai"),
    ]
    cases = with_case_defaults(spark.createDataFrame(rows, CASE))
    done = spark.createDataFrame([("zones", "openai", "unused [1]."), ("remote", "openai", "A reserved price lasts one year [1].")], "query_id string, provider string, answer string")
    results, report, missing = evaluation.run_cases(cases, chunks, registry, done, Params(min_score=0.1))
    got = {r["case_id"]: r for r in results.collect()}
    assert set(got) == {"zones", "scoped", "refuse", "remote"} and [tuple(r) for r in missing.collect()] == [("lost", ["gone.txt"])]
    assert got["zones"]["provider"] == "extractive" and got["zones"]["recall_at_k"] == 1.0 and got["zones"]["source_accuracy"] == 1.0
    assert got["remote"]["provider"] == "openai" and got["remote"]["grounded"] and got["remote"]["citation_accuracy"] == 1.0 and got["remote"]["notes"] == []
    assert got["scoped"]["source_accuracy"] == 0.0 and got["scoped"]["retrieved_total"] <= 1 and "Not all expected retrieval keywords found in top-k." in got["scoped"]["notes"]
    assert got["refuse"]["answer"] == REFUSAL and got["refuse"]["retrieved_total"] == 0 and got["refuse"]["refused_correctly"]
    r = report.first()
    assert r["num_cases"] == 4 and r["refusal_accuracy"] == 1.0 and abs(r["recall_at_k"] - sum(x["recall_at_k"] for x in got.values()) / 4) < 1e-9
    results, report, missing = evaluation.run_cases(cases.limit(0), chunks, registry, done)
    assert results.count() == missing.count() == 0 and report.first()["num_cases"] == 0


def test_conversation_run(spark):
    """A follow-up is searched with what was said before, answered as asked, and remembered."""
    chunks, _ = small_corpus(spark)
    held = turns(spark, [("system", "be kind"), ("user", "How many availability zones has a region?"), ("assistant", "Three [1].")])
    asked = spark.createDataFrame([(1, "are they isolated?"), (2, "xylophone quartz glissando over seven seas")], "conv_id long, query string")
    questions, hits, messages = converse.prepare(held, asked, chunks, Params(min_score=0.1))
    q = {r["query_id"]: r for r in questions.collect()}
    assert q[1]["standalone"] == "How many availability zones has a region? — follow-up: are they isolated?" and q[1]["turn"] == 3
    assert q[2]["standalone"] == q[2]["query"] and q[2]["turn"] == 0
    sent = {r["query_id"]: r["messages"] for r in messages.collect()}
    assert [m["role"] for m in sent[1]] == ["system", "user", "assistant", "user"] and "QUESTION: are they isolated?" in sent[1][-1]["content"]
    done = spark.createDataFrame([(1, "openai", "Zones are isolated buildings [1].")], "query_id long, provider string, answer string")
    answers, after = converse.conclude(held, questions, hits, done, Params(), primary="openai")
    a = {r["query_id"]: r for r in answers.collect()}
    assert a[1]["answer"].startswith("Zones are isolated") and a[1]["grounded"] and (a[2]["answer"], a[2]["provider"]) == (REFUSAL, "none")
    assert [(r["turn"], r["role"]) for r in after.where("conv_id = 1").orderBy("turn").collect()][-2:] == [(3, "user"), (4, "assistant")]
    assert [r["text"] for r in after.where("conv_id = 2").orderBy("turn").collect()] == [q[2]["query"], REFUSAL]


def test_last_messages(spark):
    """The last n of each thread, also of one that holds most rows, and of repeated turn numbers."""
    import random

    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randint(0, 400), r.choice(["user", "assistant"]), str(i)) for i in range(900)] + [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    for n in (1, 7, 0):
        got = {x["conv_id"]: ([tuple(t) for t in x["turns"]], x["created"], x["updated"]) for x in memory.conversation_state(df, n).collect()}
        for c in (1, 2, 3, None):
            mine = sorted(t[1:] for t in rows if t[0] == c)
            assert got[c] == (mine[-n:] if n else mine, mine[0][0], mine[-1][0])
    assert "WindowGroupLimit" in memory.last_messages(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_sweep_equals_single_selections(spark):
    from ragtables.operators import diversity
    from ragtables.queries import inputs

    pool = inputs.vectors(spark, "/root/testdata/sf0.001").where("chunk_index < 60").select(F.floor(F.col("chunk_index") / 12).cast("string").alias("query_id"), (F.col("chunk_index") % 12 + 1).cast("int").alias("rank"), "chunk_id", (1.0 / (F.col("chunk_index") % 12 + 1)).alias("score"), "vector")
    pool = pool.withColumn("vector", F.when((F.col("query_id") != "2") | (F.col("rank") != 3), F.col("vector"))).withColumn("k", F.lit(5))
    swept = diversity.mmr_sweep(pool, evaluation.COMBOS).collect()
    for w, c in evaluation.COMBOS:
        one = diversity.mmr_select(pool, lambda_=w, dedup_threshold=c, k_col="k").collect()
        assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in swept if (r["lambda"], r["cap"]) == (w, c)} == {(r["query_id"], r["rank"], r["chunk_id"]) for r in one}
