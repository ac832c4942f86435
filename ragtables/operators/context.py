"""Contexts, citations, prompts and answers of query tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, strip
from ..params import FAILED_INTRO, INTRO, REFUSAL, SPACES, SYSTEM


def group_hits(hits: DataFrame) -> DataFrame:
    """hits with doc_rank, pos and marker: documents by their best hit, inside by page and index, markers 1..n."""
    lead = F.min("rank").over(Window.partitionBy("query_id", "document_id"))
    rows = hits.withColumn("__lead", lead)
    w = Window.partitionBy("query_id")
    reading = [F.coalesce("page", F.lit(0)), F.col("chunk_index"), F.col("rank")]
    return rows.select(
        "*",
        F.dense_rank().over(w.orderBy("__lead")).alias("doc_rank"),
        F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*reading)).alias("pos"),
        F.row_number().over(w.orderBy("__lead", *reading)).alias("marker"),
    ).drop("__lead")


def _sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), rf"(?<=[.!?])[{SPACES}]+"), lambda s: s != "")


LEAST, MOST = 40, 600


def _behind(previous: str, current: str) -> str:
    """current without the longest start, of LEAST to MOST characters, that previous ends with."""
    p, c = previous.strip(), current.strip()
    # only places where the end of p could begin: found by the first LEAST characters of c
    if len(c) >= LEAST:
        at = p.find(c[:LEAST], max(0, len(p) - min(MOST, len(c))))
        while at >= 0:
            if c.startswith(p[at:]):
                return c[len(p) - at :].lstrip() or current
            at = p.find(c[:LEAST], at + 1)
    return current


def trim_overlap(grouped: DataFrame) -> DataFrame:
    """grouped with `shown`: the text without what the hit before it in the same document already gave.

    Equal texts leave nothing. After the directly preceding chunk, leading sentences among its last five go first.
    """

    @F.pandas_udf("string")
    def trim_boundary(previous: pd.Series, current: pd.Series) -> pd.Series:
        return pd.Series([c if p is None or c is None else _behind(p, c) for p, c in zip(previous, current, strict=True)])

    w = Window.partitionBy("query_id", "document_id").orderBy("pos")
    rows = grouped.withColumn("__prev", F.lag("text").over(w)).withColumn("__index", F.lag("chunk_index").over(w))
    # held in columns: what looks at them does so for each sentence
    rows = rows.withColumns({"__said": _sentences(F.col("__prev")), "__mine": _sentences(F.col("text"))})
    rows = rows.withColumn("__last", F.when(F.size("__said") < 5, F.col("__said")).otherwise(F.slice("__said", -5, 5)))
    last, mine = F.col("__last"), F.col("__mine")
    fresh = F.filter(mine, lambda s, i: F.exists(F.slice(mine, F.lit(1), i + 1), lambda t: ~F.array_contains(last, t)))
    rest = strip(F.array_join(fresh, " "))
    follows = (F.col("chunk_index") == F.col("__index") + 1) & (F.size(last) > 0) & (F.size(mine) > 0) & (rest != "")
    start = F.when(follows, rest).otherwise(F.col("text"))
    shown = F.when(F.col("__prev").isNull(), F.col("text")).when(normalize_ws(F.col("__prev")) == normalize_ws(F.col("text")), "").otherwise(trim_boundary(F.col("__prev"), start))
    return rows.withColumn("shown", shown).drop("__prev", "__index", "__said", "__mine", "__last")


def _place() -> Column:
    return F.when(F.col("page").isNotNull(), F.concat(F.lit("p."), F.col("page"))).otherwise(F.concat(F.lit("chunk "), F.col("chunk_index")))


def _joined(df: DataFrame, keys: list[str], order: str, text: str, between: str, name: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(lines, between).alias(name))


def build_grouped_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): a header per document, then its passages with their markers; a repeat refers to the one before."""
    shown = trim_overlap(group_hits(hits))
    text = F.when(strip(F.col("shown")) == "", F.concat(F.lit("(See preceding passage ["), F.col("marker") - 1, F.lit("] for full text.)"))).otherwise(F.col("shown"))
    lines = shown.withColumn("line", F.concat(F.lit("["), F.col("marker"), F.lit("] ("), _place(), F.lit(")\n"), text))
    blocks = lines.groupBy("query_id", "doc_rank").agg(F.min_by("filename", "marker").alias("filename"), F.array_sort(F.collect_list(F.struct("marker", "line"))).alias("m"))
    blocks = blocks.select("query_id", "doc_rank", F.concat(F.lit("### Source: "), F.col("filename"), F.lit("\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n")).alias("block"))
    return _joined(blocks, ["query_id"], "doc_rank", "block", "\n\n", "context")


def build_flat_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): one block per hit in rank order, with file name and page."""
    where = F.concat(F.col("filename"), F.coalesce(F.concat(F.lit(", p."), F.col("page")), F.lit("")))
    blocks = hits.withColumn("block", F.concat(F.lit("["), F.col("rank"), F.lit("] (source: "), where, F.lit(")\n"), F.col("text")))
    return _joined(blocks, ["query_id"], "rank", "block", "\n\n", "context")


def citations(hits: DataFrame, marker_col: str = "rank", length: int = 280) -> DataFrame:
    """Citation rows of the hits: marker, ids, score to four digits, snippet, whole text."""
    snippet = F.concat(F.substring("text", 1, length), F.when(F.length("text") > length, "…").otherwise(""))
    return hits.select("query_id", F.col(marker_col).alias("marker"), "document_id", "filename", "chunk_id", F.round("score", 4).alias("score"), snippet.alias("snippet"), F.col("text").alias("chunk_text"))


def build_prompt(contexts: DataFrame) -> DataFrame:
    """contexts (query_id, query, context) with prompt."""
    return contexts.withColumn("prompt", F.concat(F.lit("CONTEXT:\n"), F.col("context"), F.lit("\n\nQUESTION: "), F.col("query"), F.lit("\n\nAnswer with inline [n] citations.")))


def build_messages(prompts: DataFrame, history: DataFrame | None = None, system: str = SYSTEM) -> DataFrame:
    """(query_id, messages): system, the history (query_id, history: array<struct<role, content>>) in order, the prompt."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    rows = prompts.select("query_id", "prompt")
    past = F.array().cast("array<struct<role:string,content:string>>")
    if history is not None:
        rows, past = rows.join(history.select("query_id", "history"), "query_id", "left"), F.coalesce("history", past)
    return rows.select("query_id", F.concat(F.array(message(F.lit("system"), F.lit(system))), past, F.array(message(F.lit("user"), F.col("prompt")))).alias("messages"))


def extractive_text(prompt: Column, failed: Column | None = None) -> Column:
    """The passages of a prompt behind an introduction, which names the provider if one failed."""
    after = F.substring(prompt, F.instr(prompt, "CONTEXT:") + 8, F.length(prompt))
    inner = F.when(F.instr(prompt, "CONTEXT:") > 0, F.substring_index(after, "QUESTION:", 1)).otherwise(prompt)
    intro = F.lit(INTRO) if failed is None else F.when(failed.isNull(), F.lit(INTRO)).otherwise(F.format_string(FAILED_INTRO, failed))
    return F.concat(intro, strip(inner))


def extractive_answer(prompts: DataFrame) -> DataFrame:
    return prompts.select("query_id", extractive_text(F.col("prompt")).alias("answer"))


def select_answer(prompts: DataFrame, completions: DataFrame, *, primary_col: str = "primary", local: str = "ollama") -> DataFrame:
    """(query_id, answer, provider) from externally produced completions (query_id, provider, answer; null: failed).

    The primary provider's answer, else for remote providers the local one's, else the extractive answer.
    """
    answers = completions.where("answer is not null").groupBy("query_id", "provider").agg(F.min("answer").alias("answer"))
    first = answers.select("query_id", F.col("provider").alias(primary_col), F.col("answer").alias("__a"))
    second = answers.where(F.col("provider") == local).select("query_id", F.col("answer").alias("__b"))
    rows = prompts.join(first, ["query_id", primary_col], "left").join(second, "query_id", "left")
    b = F.when(F.col(primary_col) != "extractive", F.col("__b"))
    extract = extractive_text(F.col("prompt"), F.when(F.col(primary_col) != "extractive", F.col(primary_col)))
    provider = F.when(F.col("__a").isNotNull(), F.col(primary_col)).when(b.isNotNull(), F.lit(local)).otherwise(F.lit("extractive"))
    return rows.select("query_id", F.coalesce("__a", b, extract).alias("answer"), provider.alias("provider"))


def assemble_results(gate: DataFrame, answers: DataFrame, validated: DataFrame) -> DataFrame:
    """(query_id, answer, provider, grounded): the refusal where the gate says so, else the checked answer.

    An answer that is the refusal text itself skips the check and counts as grounded.
    """
    rows = gate.select("query_id", "refuse").join(answers.select("query_id", F.col("answer").alias("__raw"), "provider"), "query_id", "left").join(validated.select("query_id", F.col("answer").alias("__checked"), F.col("grounded").alias("__ok")), "query_id", "left")
    refusal = F.col("refuse") | F.col("__raw").isNull()
    said = F.col("__raw") == REFUSAL
    return rows.select(
        "query_id",
        F.when(refusal, REFUSAL).when(said, F.col("__raw")).otherwise(F.coalesce("__checked", "__raw")).alias("answer"),
        F.when(refusal, "none").otherwise(F.col("provider")).alias("provider"),
        F.when(refusal, False).when(said, True).otherwise(F.coalesce("__ok", F.lit(True))).alias("grounded"),
    )
