"""Scores of labelled question sets, reports, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import numbers, strip_citations
from ..functions.text import contains_ci, strip
from ..functions.vectors import dot
from ..params import METRIC_STOPWORDS, REFUSAL
from .validate import claims, support

METRICS = ("precision_at_k", "recall_at_k", "citation_accuracy", "answer_keyword_recall", "source_accuracy", "redundancy")


def _none() -> Column:
    return F.array().cast("array<string>")


def _share(found: Column, total: Column) -> Column:
    return found.cast("double") / F.when(total == 0, None).otherwise(total)


def is_refusal(answer: Column) -> Column:
    return strip(answer) == REFUSAL


def is_relevant(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: contains_ci(text, k))


def precision_at_k(texts: Column, keywords: Column) -> Column:
    """Relevant hits over returned hits; 0 without hits."""
    return F.coalesce(_share(F.size(F.filter(texts, lambda t: is_relevant(t, keywords))), F.size(texts)), F.lit(0.0))


def recall_at_k(texts: Column, keywords: Column, should_refuse: Column) -> Column:
    """Keywords found in the hits' joined text over all; without keywords 1 for refusal cases, else 0."""
    found = F.size(F.filter(keywords, lambda k: contains_ci(F.array_join(texts, "\n"), k)))
    return F.coalesce(_share(found, F.size(keywords)), should_refuse.cast("double"))


def answer_keyword_recall(answer: Column, keywords: Column, should_refuse: Column) -> Column:
    found = _share(F.size(F.filter(keywords, lambda k: contains_ci(answer, k))), F.size(keywords))
    return F.when(F.size(keywords) == 0, (is_refusal(answer) == should_refuse).cast("double")).when(is_refusal(answer), 0.0).otherwise(found)


def citation_accuracy(answer: Column, texts: Column, groups: Column | None = None, stopwords: Sequence[str] = METRIC_STOPWORDS) -> Column:
    """Share of citation groups that a cited text backs; 1 for refusals and without hits, 0 without groups.

    texts: lower case. groups: the answer's claims, where a column holds them.
    """
    n, backed = support(claims(answer, stopwords) if groups is None else groups, texts)
    return F.when(is_refusal(answer) | (F.size(texts) == 0), 1.0).otherwise(F.coalesce(_share(backed, n), F.lit(0.0)))


def hallucination_flag(answer: Column, texts: Column, should_refuse: Column, forbidden: Column) -> Column:
    """Whether a refusal was due and not given; or the answer has a forbidden word or a number that the hits lack."""
    context = F.lower(F.array_join(texts, "\n"))
    bare = strip_citations(answer)
    word = F.exists(forbidden, lambda k: contains_ci(bare, k) & ~contains_ci(context, k))
    facts = F.filter(numbers(bare), lambda x: ~F.rlike(x, F.lit(r"^(?:19|20)\d\d$")))
    return F.when(should_refuse, ~is_refusal(answer)).when(is_refusal(answer), False).otherwise(word | (F.size(F.array_except(facts, numbers(context))) > 0))


def source_accuracy(filenames: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).when(F.size(filenames) == 0, 0.0).otherwise(F.arrays_overlap(filenames, expected).cast("double"))


def refused_correctly(answer: Column, should_refuse: Column) -> Column:
    return is_refusal(answer) == should_refuse


def redundancy(hits: DataFrame) -> DataFrame:
    """(query_id, redundancy): largest cosine between two of a query's hits with vectors; 0 with fewer than two."""
    v = hits.where("vector is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("v"))
    each = F.transform("v", lambda a: F.array_max(F.transform(F.filter("v", lambda b: b["rank"] > a["rank"]), lambda b: dot(a["vector"], b["vector"]))))
    known = v.select("query_id", F.array_max(each).alias("r"))
    return hits.select("query_id").distinct().join(known, "query_id", "left").select("query_id", F.coalesce("r", F.lit(0.0)).alias("redundancy"))


def score_cases(cases: DataFrame, answers: DataFrame, hits: DataFrame, redundant: DataFrame | None = None) -> DataFrame:
    """All metrics of every case (id, should_refuse, keyword lists) from answers and hits keyed by query_id = case id."""
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "filename"))).alias("h"))
    rows = cases.join(answers.select(F.col("query_id").alias("id"), "answer"), "id").join(got.withColumnRenamed("query_id", "id"), "id", "left")
    rows = rows.withColumns({"__t": F.coalesce(F.transform("h", lambda x: x["text"]), _none()), "__f": F.coalesce(F.transform("h", lambda x: x["filename"]), _none())})
    rows = rows.join(redundant.select(F.col("query_id").alias("id"), "redundancy"), "id", "left") if redundant is not None else rows.withColumn("redundancy", F.lit(0.0))
    rows = rows.withColumns({"__low": F.transform("__t", F.lower), "__g": claims(F.col("answer"), METRIC_STOPWORDS)})
    answer, texts, refuse, keys = F.col("answer"), F.col("__t"), F.col("should_refuse"), F.col("relevant_keywords")
    return rows.select(
        F.col("id").alias("case_id"),
        precision_at_k(texts, keys).alias("precision_at_k"),
        recall_at_k(texts, keys, refuse).alias("recall_at_k"),
        hallucination_flag(answer, texts, refuse, F.col("forbidden_answer_keywords")).alias("hallucination"),
        citation_accuracy(answer, F.col("__low"), F.col("__g")).alias("citation_accuracy"),
        answer_keyword_recall(answer, F.col("expected_answer_keywords"), refuse).alias("answer_keyword_recall"),
        refused_correctly(answer, refuse).alias("refused_correctly"),
        F.size(F.filter(texts, lambda t: is_relevant(t, keys))).alias("retrieved_relevant"),
        F.size(texts).alias("retrieved_total"),
        source_accuracy(F.col("__f"), F.col("expected_source_filenames")).alias("source_accuracy"),
        F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"),
    )


def case_notes(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, notes): what went wrong with each case."""
    rows = metrics.join(cases.select(F.col("id").alias("case_id"), "should_refuse", "expected_source_filenames"), "case_id")
    notes = F.array(
        F.when(F.col("should_refuse") & ~F.col("refused_correctly"), "Expected refusal but got an answer."),
        F.when(~F.col("should_refuse") & (F.col("recall_at_k") < 1), "Not all expected retrieval keywords found in top-k."),
        F.when(F.col("hallucination"), "Hallucination heuristic triggered."),
        F.when((F.size("expected_source_filenames") > 0) & (F.col("source_accuracy") < 1), "Expected source document not found in top-k."),
    )
    return rows.select("case_id", F.filter(notes, lambda x: x.isNotNull()).alias("notes"))


def build_report(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: means over all scored cases; refusal accuracy over refusal cases (1 if the set has none, 0 if none was scored)."""
    refusals = cases.where("should_refuse").select(F.col("id").alias("case_id"), F.lit(True).alias("__r"))
    total = refusals.agg(F.count("*").alias("__n"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    report = metrics.join(refusals, "case_id", "left").agg(
        F.count("*").alias("num_cases"),
        *(mean(c).alias(c) for c in METRICS),
        mean(F.col("hallucination").cast("double")).alias("hallucination_rate"),
        mean(F.when(F.col("__r"), F.col("refused_correctly").cast("double"))).alias("__ra"),
    )
    return report.join(F.broadcast(total)).withColumn("refusal_accuracy", F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__ra"))).drop("__n", "__ra")


def merge_reports(old: DataFrame, new: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Case metrics of both runs (new ones win, cases outside the set are dropped), and the report over them."""
    kept = old.join(new.select("case_id"), "case_id", "left_anti").unionByName(new)
    kept = kept.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_semi")
    return kept, build_report(kept, cases)


def select_cases(cases: DataFrame, ids: Sequence[str]) -> DataFrame:
    return cases.where(F.col("id").isin(*ids))


def run_agreement(runs: DataFrame) -> DataFrame:
    """One row: in how many cases all runs (run, case_id, chunk_id) retrieved the same set of chunks, and of how many."""
    sets = runs.groupBy("run", "case_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("s"))
    cases = sets.groupBy("case_id").agg(F.count_distinct(F.to_json(F.struct("s"))).alias("n"), F.count("*").alias("r"))
    every = runs.agg(F.count_distinct("run").alias("k"))
    return cases.join(F.broadcast(every)).agg(F.count_if((F.col("n") == 1) & (F.col("r") == F.col("k"))).alias("agreements"), F.count("*").alias("total"))


def latency_summary(results: DataFrame) -> DataFrame:
    """One row over elapsed_seconds rounded to 1 digit: cases, mean, median, least, most."""
    s = results.select(F.round("elapsed_seconds", 1).alias("s"))
    return s.agg(F.count("*").alias("num_cases"), F.avg("s").alias("mean_s"), F.percentile("s", 0.5).alias("median_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def compare_selections(off: DataFrame, on: DataFrame) -> DataFrame:
    """Two final hit lists per query: whether the ordered list changed, and how many chunks are new."""
    def lists(hits: DataFrame, name: str) -> DataFrame:
        return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))

    rows = lists(off, "off").join(lists(on, "on"), "query_id", "full")
    rows = rows.withColumns({c: F.coalesce(c, _none()) for c in ("off", "on")})
    return rows.select("query_id", (F.col("off") != F.col("on")).alias("changed"), F.size(F.array_except("on", "off")).cast("long").alias("new_chunks"))
