"""Second-stage scoring of (query, chunk) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .search import ranked


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the default scorer, which needs no model."""
    return _share(_asked(query), words(text))


def _asked(query: Column) -> Column:
    return F.array_distinct(words(query))


def _share(q: Column, of: Column) -> Column:
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, of)) / F.size(q))


def rerank(hits: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """hits with the scorer's scores, ranked by them; equal scores keep their order. scorer may be a pandas_udf."""
    scored = hits.join(queries.select("query_id", "query"), "query_id").withColumn("score", scorer(F.col("query"), F.col("text")).cast("double")).drop("query")
    return ranked(scored.withColumnRenamed("rank", "__old"), "__old").select(*hits.columns)


def rerank_over_variants(hits: DataFrame, variants: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap) -> DataFrame:
    """The same with the best score over a query's variants (query_id, variant)."""
    if scorer is token_overlap:  # the words of a text and of a variant are taken once, not for each pair
        asked = variants.groupBy("query_id").agg(F.collect_list(_asked(F.col("variant"))).alias("__asked"))
        best = lambda of: F.array_max(F.transform("__asked", lambda q: _share(q, of)))
        pairs = hits.join(asked, "query_id").withColumn("score", F.transform(F.array(words(F.col("text"))), best)[0])
    else:
        pairs = hits.join(variants.select("query_id", "variant"), "query_id").withColumn("score", scorer(F.col("variant"), F.col("text")).cast("double"))
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id", "score", "rank")]
    best = pairs.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("__old"), *(F.first(c).alias(c) for c in others))
    return ranked(best, "__old").select(*hits.columns)
