"""Evaluation runs: whole sets of labelled questions, sweeps of diversity parameters, and rewriting on against off."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..functions.vectors import dot
from ..operators import catalog, context, diversity, evaluate, promote, rerank
from ..params import Params
from ..sources.tables import checkpointed
from . import answer, retrieve

COMBOS = ((0.7, 1.01), (0.7, 0.95), (0.7, 0.90), (0.7, 0.85), (0.5, 0.90), (0.5, 0.85), (0.6, 0.88))


def run_cases(
    cases: DataFrame, chunks: DataFrame, registry: DataFrame, completions: DataFrame, params: Params = Params(), *, primary: str = "extractive", **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, report, missing) of a set of labelled questions (sources.files.CASE), from their scopes to the report.

    results: case_id, query, answer, provider, grounded, all metrics, notes. missing: cases that name files which the
    registry lacks; these are not run. completions: query_id = case id, see operators.context.select_answer. A case may
    bring its own top_k and, where its mode is not auto, its own primary provider. A refused case has no hits.
    """
    ids, missing = catalog.resolve_document_ids(cases, registry)
    missing = checkpointed(missing)
    cases = checkpointed(cases.join(missing, cases["id"] == missing["case_id"], "left_anti").join(ids.withColumnRenamed("case_id", "id"), "id", "left"))
    own = F.when(F.col("mode") != "auto", F.col("mode")).cast("string") if "mode" in cases.columns else F.lit(None).cast("string")
    top_k = F.col("top_k") if "top_k" in cases.columns else F.lit(None)
    asked = cases.select(F.col("id").alias("query_id"), "query", top_k.cast("int").alias("top_k"), F.col("document_ids").alias("scope"), own.alias("primary"))
    hits = checkpointed(retrieve.retrieve(asked, chunks, params, **options))
    answers = checkpointed(answer.answer(asked, hits, completions, params, primary=primary))
    # an answer cites its passages by marker
    shown = hits.join(answers.where("provider <> 'none'"), "query_id", "left_semi")
    shown = context.group_hits(shown).drop("rank").withColumnRenamed("marker", "rank")
    metrics = checkpointed(evaluate.score_cases(cases, answers, shown, evaluate.redundancy(shown)))
    told = answers.withColumnRenamed("query_id", "case_id").join(cases.select(F.col("id").alias("case_id"), "query"), "case_id")
    results = told.select("case_id", "query", "answer", "provider", "grounded").join(metrics, "case_id").join(evaluate.case_notes(metrics, cases), "case_id")
    return results, evaluate.build_report(metrics, cases), missing


def sweep_mmr(cases: DataFrame, candidates: DataFrame, combos: Sequence[tuple[float, float]] = COMBOS, params: Params = Params()) -> DataFrame:
    """Per (lambda, cap): mean precision, recall, redundancy and hits over answerable cases. candidates: pools by query_id = case id.

    Every pool is held once, with one matrix of similarities for all combinations; only what they select is repeated. A
    case may bring its own top_k.
    """
    own = F.coalesce("top_k", F.lit(params.top_k)) if "top_k" in cases.columns else F.lit(params.top_k)
    cases = cases.where("not should_refuse").select(F.col("id").alias("base"), "query", "relevant_keywords", "should_refuse", own.alias("k"))
    key = F.concat_ws("\x1f", "base", F.col("c.lambda").cast("string"), F.col("c.cap").cast("string"))
    each = F.explode(F.array(*(F.struct(F.lit(float(w)).alias("lambda"), F.lit(float(c)).alias("cap")) for w, c in combos)))
    asked = cases.withColumn("c", each).withColumn("query_id", key)
    pools = checkpointed(candidates)
    picked = diversity.mmr_sweep(pools.join(cases.select(F.col("base").alias("query_id"), "k"), "query_id"), combos).drop("k")
    picked = picked.withColumns({"base": F.col("query_id"), "c": F.struct("lambda", "cap")}).withColumn("query_id", key)
    hits = checkpointed(picked.select(*pools.columns))
    hits = promote.promote_hits(diversity.dedupe_by_text(hits, params.dedupe_jaccard), pools, asked, k_col="k", pool_col="base")
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "vector"))).alias("h"))
    rows = asked.join(got, "query_id", "left")
    texts = F.coalesce(F.transform("h", lambda x: x["text"]), F.array().cast("array<string>"))
    pair = F.transform("h", lambda a: F.array_max(F.transform(F.filter("h", lambda b: b["rank"] > a["rank"]), lambda b: dot(a["vector"], b["vector"]))))
    return rows.groupBy("c").agg(
        F.avg(evaluate.precision_at_k(texts, F.col("relevant_keywords"))).alias("precision"),
        F.avg(evaluate.recall_at_k(texts, F.col("relevant_keywords"), F.col("should_refuse"))).alias("recall"),
        F.avg(F.coalesce(F.array_max(pair), F.lit(0.0))).alias("redundancy"),
        F.avg(F.size(texts)).alias("hits"),
    ).select("c.*", "precision", "recall", "redundancy", "hits")


def compare_rewrite(queries: DataFrame, chunks: DataFrame, params: Params = Params(), *, k: int | None = None) -> DataFrame:
    """Per query (query_id, query, keyword) with rewriting off and on: pool size, keyword hits, redundancy, and the change.

    Both runs rerank by the original query and select diversely only from pools of more than k, without a hard cap.
    """
    k = k or params.top_k

    def final(on: bool) -> tuple[DataFrame, DataFrame]:
        pool = checkpointed(retrieve.pool(queries.select("query_id", "query"), chunks, replace(params, rewrite=on, rerank=False)))
        hits = rerank.rerank(pool, queries)
        return pool, checkpointed(diversity.mmr_select(hits, k, params.mmr_lambda, 1.01))

    tables = []
    for name, on in (("off", False), ("on", True)):
        pool, hits = final(on)
        size = pool.groupBy("query_id").agg(F.count("*").alias(f"pool_{name}"))
        found = hits.join(queries.select("query_id", "keyword"), "query_id").groupBy("query_id").agg(F.count_if(contains_ci(F.col("text"), F.col("keyword"))).alias(f"keyword_hits_{name}"))
        tables.append((hits, size.join(found, "query_id").join(evaluate.redundancy(hits).withColumnRenamed("redundancy", f"redundancy_{name}"), "query_id")))
    both = evaluate.compare_selections(tables[0][0], tables[1][0])
    return both.join(tables[0][1], "query_id", "left").join(tables[1][1], "query_id", "left")
