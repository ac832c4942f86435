"""Retrieval for a table of queries, from rewriting to the final hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diversity, promote, rerank, rewrite, search
from ..params import Params
from ..sources.tables import checkpointed


def pool(queries: DataFrame, chunks: DataFrame, params: Params = Params(), *, encoder: Callable | None = None, prefix: str = "", scorer: Callable = rerank.token_overlap) -> DataFrame:
    """Ranked candidates of every query (query_id, query, optional top_k, scope): fused over its variants and reranked."""
    fields = ("filename", "page", "text", "vector")
    sized = search.pool_size(queries.withColumn("top_k", F.coalesce("top_k", F.lit(params.top_k)) if "top_k" in queries.columns else F.lit(params.top_k)), params)
    asked = checkpointed(rewrite.rewrite_queries(sized, params.num_variants, params.rules, enabled=params.rewrite))  # read many times
    keyed = asked.withColumn("original", F.col("query_id")).withColumn("query_id", F.concat_ws("\x1f", F.col("query_id").cast("string"), "variant_no"))
    vectors = search.embed_queries(keyed, "variant", encoder, prefix=prefix, dim=params.dim)
    hits = search.knn(vectors, chunks, k_col="pool_k")
    back = keyed.select(F.col("query_id").alias("__k"), F.col("original"))
    hits = hits.join(back, F.col("query_id") == F.col("__k")).drop("query_id", "__k").withColumnRenamed("original", "query_id")
    # texts and vectors are fetched for what is left of all variants
    fused = search.fetched(search.fuse_variants(hits, params.min_score), chunks, list(fields))
    fused = fused.select("query_id", "rank", *search.IDS, *fields, "score")
    return rerank.rerank_over_variants(fused, asked, scorer) if params.rerank else fused


def select(candidates: DataFrame, queries: DataFrame, params: Params = Params(), *, diverse: bool = True) -> DataFrame:
    """The final hits from the candidates: diversity, text dedupe, promotion, top k.

    diverse=False promotes over the plain candidates, as if diversity and text dedupe were off.
    """
    asked = queries.select("query_id", "query", (F.coalesce("top_k", F.lit(params.top_k)) if "top_k" in queries.columns else F.lit(params.top_k)).alias("k"))
    hits = candidates
    if diverse and params.mmr:
        hits = diversity.mmr_select(hits, lambda_=params.mmr_lambda, dedup_threshold=params.mmr_cap, k_of=asked)
    if diverse:
        hits = diversity.dedupe_by_text(checkpointed(hits), params.dedupe_jaccard)
    return promote.promote_hits(hits, candidates, asked, k_col="k")


def retrieve(queries: DataFrame, chunks: DataFrame, params: Params = Params(), *, diverse: bool = True, **options) -> DataFrame:
    """Final hits of every query: query_id, rank, chunk_id, document_id, filename, chunk_index, page, text, score, vector."""
    return select(checkpointed(pool(queries, chunks, params, **options)), queries, params, diverse=diverse)
