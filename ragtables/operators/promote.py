"""Promotion of hits that match the query's kind, and the confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.queries import extract_identifiers
from ..params import AFTER, BEFORE, FAMILY

FEW = 20_000  # queries of a kind that are broadcast once they are counted


def family_query(query: Column) -> Column:
    return F.rlike(query, F.lit(f"(?i){BEFORE}{FAMILY}{AFTER}"))


def family_text(text: Column) -> Column:
    """Whether a text defines the memory family."""
    has = lambda s: F.contains(F.lower(text), F.lit(s))
    return has("memory optimized") & has("designed") & (has("workload") | has("data sets in memory"))


def promote_hits(hits: DataFrame, pool: DataFrame, queries: DataFrame, k: int | None = None, *, k_col: str | None = None, pool_col: str = "query_id") -> DataFrame:
    """hits cut to the best k; if none of these matches the query's identifiers or family, the best match of pool leads.

    queries: query_id, query (and k_col). hits and pool have the same columns. pool_col: the column of queries that
    names their pool, where several share one.
    """
    asked = queries.select("query_id", extract_identifiers(F.col("query")).alias("__ids"), family_query(F.col("query")).alias("__family"), (F.col(k_col) if k_col else F.lit(k)).alias("__k"))
    match = F.exists("__ids", lambda i: F.contains(F.lower("text"), i)) | (F.col("__family") & family_text(F.col("text")))
    flagged = lambda df: df.join(asked, "query_id").withColumn("__m", match)
    top = flagged(hits).where("rank <= __k")
    settled = top.where("__m").select("query_id").distinct()
    row = F.struct(*hits.columns)
    of_pool = queries.select(F.col(pool_col).alias("__pool"), "query").distinct()
    kinds = of_pool.select("__pool", extract_identifiers(F.col("query")).alias("__ids"), family_query(F.col("query")).alias("__family"))
    kinds = kinds.where((F.size("__ids") > 0) | F.col("__family"))  # nothing matches the others
    kinds = F.broadcast(kinds) if kinds.count() <= FEW else kinds
    best = pool.join(kinds, F.col("query_id") == F.col("__pool")).where(match).groupBy("__pool").agg(F.min_by(row, "rank").alias("__r"))
    first = queries.select("query_id", F.col(pool_col).alias("__pool")).join(best, "__pool").join(settled, "query_id", "left_anti").select("query_id", "__r")
    rest = top.join(first.select("query_id", F.col("__r.chunk_id").alias("__lead")), "query_id", "left").where("__lead is null or chunk_id <> __lead")
    moved = rest.withColumn("rank", F.col("rank") + F.col("__lead").isNotNull().cast("int")).where("rank <= __k").select(*hits.columns)
    led = first.select(F.col("query_id").alias("__q"), "__r.*").withColumns({"rank": F.lit(1), "query_id": F.col("__q")}).select(*hits.columns)
    return moved.unionByName(led)


def retrieval_gate(hits: DataFrame, queries: DataFrame, min_score: float = 0.0, *, enabled: bool = True) -> DataFrame:
    """(query_id, refuse, best): refuse where there is no hit, or the best score is below the minimum."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    below = (F.col("best") < min_score) if enabled else F.lit(False)
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.when(F.col("best").isNull(), True).otherwise(below), F.lit(True)).alias("refuse"), "best")
