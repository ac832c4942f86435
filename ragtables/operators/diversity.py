"""Diverse selection inside a query's pool, and removal of texts that repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.tables import checkpointed

FEW = 50_000  # queries whose picks are broadcast once they are counted


def minmax_relevance(hits: DataFrame) -> DataFrame:
    """hits with relevance: scores scaled to 0..1 inside the query, all 1 where they hardly differ."""
    w = Window.partitionBy("query_id")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return hits.withColumn("relevance", F.when(span < 1e-9, 1.0).otherwise((F.col("score") - low) / span))


def _greedy(score: np.ndarray, similar: np.ndarray, weight: float, k: int, cap: float) -> list[int]:
    """Places in the order in which they are taken. nearest[i]: similarity to the nearest one taken (0 while there is none)."""
    span = score.max() - score.min()
    relevance = np.ones(len(score)) if span < 1e-9 else (score - score.min()) / span
    nearest, left, taken = np.zeros(len(score)), np.ones(len(score), bool), []
    while len(taken) < k:
        gain = np.where(left & (nearest < cap), weight * relevance - (1 - weight) * nearest, -np.inf)
        best = int(gain.argmax())
        if gain[best] == -np.inf:
            break
        nearest = similar[best].copy() if not taken else np.maximum(nearest, similar[best])
        taken.append(best)
        left[best] = False
    return taken


def _chosen(hits: DataFrame, picks: DataFrame) -> DataFrame:
    """The picked hits (query_id, picks: ranks in the new order) with new ranks."""
    picks = checkpointed(picks)
    order = picks.select(F.col("query_id").alias("__q"), F.posexplode("picks").alias("__p", "__r"))
    order = F.broadcast(order) if picks.count() <= FEW else order  # the hits, with texts and vectors, stay where they are
    kept = hits.join(order, (F.col("query_id") == F.col("__q")) & (F.col("rank") == F.col("__r")))
    return kept.select(*((F.col("__p") + 1).cast("int").alias("rank") if c == "rank" else F.col(c) for c in hits.columns))


def mmr_select(hits: DataFrame, k: int | None = None, lambda_: float = 0.6, dedup_threshold: float = 0.85, *, k_col: str | None = None, k_of: DataFrame | None = None, lambda_col: str | None = None, cap_col: str | None = None) -> DataFrame:
    """Maximal marginal relevance: hits (with `vector`) chosen greedily by lambda * relevance - (1 - lambda) * similarity.

    A candidate as similar as the threshold to one already chosen is never taken, so fewer than k may remain. A single
    hit, or a pool in which any vector is missing, keeps its order. k, lambda and the threshold may come from columns, k
    also from a table of its own, k_of (query_id, k).
    """
    given = lambda c, v: F.max(c) if c else F.max(F.lit(v))
    pools = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vector"))).alias("pool"), given(k_col, 0 if k is None else k).alias("k"), given(lambda_col, lambda_).cast("double").alias("weight"), given(cap_col, dedup_threshold).cast("double").alias("cap"))
    if k_of is not None:
        pools = pools.drop("k").join(k_of.select("query_id", "k"), "query_id")

    @F.pandas_udf("array<int>")
    def pick(pool: pd.Series, k: pd.Series, weight: pd.Series, cap: pd.Series) -> pd.Series:
        out = []
        for rows, n, w, c in zip(pool, k, weight, cap, strict=True):
            rows, n = list(rows), int(n)
            if len(rows) <= 1 or any(r["vector"] is None for r in rows):
                chosen = range(min(n, len(rows)))
            else:
                v = np.stack([np.asarray(r["vector"], float) for r in rows])
                chosen = _greedy(np.array([r["score"] for r in rows]), np.round(v @ v.T, 9), w, n, c)
            out.append([rows[i]["rank"] for i in chosen])
        return pd.Series(out)

    return _chosen(hits, pools.select("query_id", pick("pool", "k", "weight", "cap").alias("picks")))


def mmr_sweep(hits: DataFrame, combos: Sequence[tuple[float, float]], k_col: str = "k") -> DataFrame:
    """The hits that mmr_select takes under each (lambda, cap), with columns `lambda` and `cap` and the rank among them.

    A pool is gathered once and its similarities are computed once for all combinations.
    """
    pools = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vector"))).alias("pool"), F.max(k_col).alias("k"))

    @F.pandas_udf("array<array<int>>")
    def pick(pool: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for rows, n in zip(pool, k, strict=True):
            rows, n = list(rows), int(n)
            if len(rows) <= 1 or any(r["vector"] is None for r in rows):
                chosen = [range(min(n, len(rows)))] * len(combos)
            else:
                v = np.stack([np.asarray(r["vector"], float) for r in rows])
                score, similar = np.array([r["score"] for r in rows]), np.round(v @ v.T, 9)
                chosen = [_greedy(score, similar, w, n, c) for w, c in combos]
            out.append([[rows[i]["rank"] for i in places] for places in chosen])
        return pd.Series(out)

    tried = F.array(*(F.struct(F.lit(float(w)).alias("lambda"), F.lit(float(c)).alias("cap")) for w, c in combos))
    each = pools.select("query_id", F.explode(F.arrays_zip(tried.alias("c"), pick("pool", "k").alias("picks"))).alias("x"))
    order = each.select(F.col("query_id").alias("__q"), F.col("x.c.lambda").alias("lambda"), F.col("x.c.cap").alias("cap"), F.posexplode("x.picks").alias("__p", "__r"))
    kept = hits.drop("lambda", "cap").join(order, (F.col("query_id") == F.col("__q")) & (F.col("rank") == F.col("__r")))
    return kept.withColumn("rank", (F.col("__p") + 1).cast("int")).drop("__q", "__p", "__r")


def dedupe_by_text(hits: DataFrame, jaccard: float = 0.85) -> DataFrame:
    """hits in rank order without those whose words equal, or overlap by jaccard with, those of one kept before."""
    pools = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", words(F.col("text")).alias("w")))).alias("pool"))

    @F.pandas_udf("array<int>")
    def keep(pool: pd.Series) -> pd.Series:
        out = []
        for rows in pool:
            kept, seen = [], set()
            for r in rows:
                form, bag = tuple(r["w"]), set(r["w"])
                near = any(bag and other and len(bag & other) / len(bag | other) >= jaccard for _, other in kept)
                if form not in seen and not near:
                    kept.append((r["rank"], bag))
                    seen.add(form)
            out.append([r for r, _ in kept])
        return pd.Series(out)

    return _chosen(hits, pools.select("query_id", keep("pool").alias("picks")))
