"""Removal of repeated chunks, by partial aggregation so that common text does not gather in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ws


def _key() -> Column:
    return F.sha2(normalize_ws(F.col("text")).cast("binary"), 256)


def _first(chunks: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    rows = chunks.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(*order).alias("__o"), F.struct(*chunks.columns).alias("__r"))
    return rows.groupBy(*names).agg(F.min_by("__r", "__o").alias("__r")).select("__r.*")


def drop_duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """Within each document the first of equal chunks (white space and case aside). chunk_index keeps its gaps."""
    return _first(chunks, [F.col("document_id"), _key()], ["chunk_index"])


def compact_corpus(chunks: DataFrame, order: tuple[str, ...] = ("document_id", "chunk_index")) -> tuple[DataFrame, DataFrame]:
    """The first of equal chunks in the whole corpus, and one row: before, after, removed."""
    kept = _first(chunks, [_key()], list(order))
    stats = chunks.agg(F.count("*").alias("before"), F.count_distinct(_key()).alias("after"))
    return kept, stats.withColumn("removed", F.col("before") - F.col("after"))
