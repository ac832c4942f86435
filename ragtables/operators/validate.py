"""Checks of cited answers against their passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import citation_groups, claim_tokens, group_supported
from ..functions.text import word_count
from ..params import DISCLAIMER, VALIDATION_STOPWORDS


def claims(answer: Column, stopwords: Sequence[str]) -> Column:
    """array<struct<tokens, markers>> of the citation groups. To be held in a column: what looks at it does so many times."""
    return F.transform(citation_groups(answer), lambda g: F.struct(claim_tokens(g["claim"], stopwords).alias("tokens"), g["markers"].alias("markers")))


def support(groups: Column, texts: Column) -> tuple[Column, Column]:
    """Number of claims, and of those that a cited text backs. groups: see claims; texts: lower case, by marker, held in a column."""
    return F.size(groups), F.size(F.filter(groups, lambda g: group_supported(g["tokens"], g["markers"], texts)))


def validated(answers: DataFrame, min_support: float = 0.5, stopwords: Sequence[str] = VALIDATION_STOPWORDS) -> DataFrame:
    """answers (answer, texts: passages by marker) with passed, support, invalid_markers, notes. Needs no other row."""
    rows = answers.withColumns({
        "__groups": claims(F.col("answer"), stopwords),
        "__texts": F.transform(F.coalesce("texts", F.array().cast("array<string>")), F.lower),
    })
    n, backed = support(F.col("__groups"), F.col("__texts"))
    marks = F.flatten(F.transform("__groups", lambda g: g["markers"]))
    rows = rows.withColumns({"__n": n, "__b": backed, "__hits": F.size("__texts"), "__words": word_count(F.col("answer"))})
    rows = rows.withColumn("invalid_markers", F.filter(marks, lambda m: (m < 1) | (m > F.col("__hits"))))
    bare = F.col("__n") == 0
    uncited = bare & (F.col("__hits") > 0) & (F.col("__words") > 12)
    rows = rows.withColumn("support", F.when(uncited, 0.0).when(bare, 1.0).otherwise(F.col("__b") / F.greatest("__n", F.lit(1))))
    weak = ~bare & (F.col("support") < min_support)
    notes = F.array(
        F.when(uncited, "Answer makes claims but contains no [n] citations."),
        F.when(F.size("invalid_markers") > 0, F.concat(F.lit("Answer cites passages that do not exist: ["), F.array_join(F.transform(F.array_sort(F.array_distinct("invalid_markers")), lambda x: x.cast("string")), ", "), F.lit("]."))),
        F.when(weak, F.concat(F.lit("Only "), F.bround(F.col("support") * 100).cast("int"), F.lit("% of citations are supported by their sources."))),
    )
    return rows.withColumns({"passed": ~uncited & ~weak & (F.size("invalid_markers") == 0), "notes": F.filter(notes, lambda x: x.isNotNull())}).drop("__groups", "__texts", "__n", "__b", "__hits", "__words")


def with_texts(answers: DataFrame, hits: DataFrame, marker_col: str = "rank") -> DataFrame:
    """answers with `texts`, the passages of the query in marker order."""
    texts = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(marker_col, "text"))), lambda x: x["text"]).alias("texts"))
    return answers.join(texts, "query_id", "left")


def validate_answers(answers: DataFrame, hits: DataFrame, min_support: float = 0.5, *, marker_col: str = "rank", stopwords: Sequence[str] = VALIDATION_STOPWORDS) -> DataFrame:
    """The same for answers (query_id, answer) and hits in their own tables."""
    return validated(with_texts(answers, hits, marker_col), min_support, stopwords).drop("texts")


def apply_validation(checked: DataFrame) -> DataFrame:
    """checked with the disclaimer behind answers that failed, and grounded."""
    return checked.withColumns({"answer": F.when(F.col("passed"), F.col("answer")).otherwise(F.concat("answer", F.lit(DISCLAIMER))), "grounded": F.col("passed")})
