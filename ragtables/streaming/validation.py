"""Answer checks on streams: answers meet the hits that they rest on, or are refused when the time is up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import apply_validation, validated
from ..params import REFUSAL, Params


def check_stream(answers: DataFrame, params: Params = Params()) -> DataFrame:
    """answers (query_id, answer, texts, best) as (query_id, answer, grounded, support, notes).

    Without passages, or with a best score below the gate, the answer is the refusal.
    """
    refuse = (F.size(F.coalesce("texts", F.array().cast("array<string>"))) == 0) | (F.lit(params.gate) & (F.coalesce("best", F.lit(0.0)) < params.gate_min))
    checked = apply_validation(validated(answers.withColumn("__raw", F.col("answer")), params.min_support))
    said = F.col("__raw") == REFUSAL
    return checked.select(
        "query_id",
        F.when(refuse, REFUSAL).when(said, F.col("__raw")).otherwise(F.col("answer")).alias("answer"),
        F.when(refuse, False).when(said, True).otherwise(F.col("grounded")).alias("grounded"),
        "support", "notes",
    )


def hit_messages(hits: DataFrame, found_at: F.Column, marker_col: str = "rank") -> DataFrame:
    """Hits as the stream carries them: one row per query (query_id, texts by marker, best, found_at)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(marker_col, "text"))), lambda x: x["text"])
    return hits.groupBy("query_id").agg(texts.alias("texts"), F.max("score").alias("best")).withColumn("found_at", found_at)


def check_answers(answers: DataFrame, hits: DataFrame, params: Params = Params(), *, wait: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """A stream of answers (query_id, answer, sent_at) beside a stream of hit messages (query_id, texts, best, found_at), checked.

    An answer waits for hits of its query that were found at most `wait` before or after it was sent; rows may be late by
    `delay`. State is kept for as long as that and no longer: when the watermark has passed, an answer without hits goes
    out as the refusal, and hits that come later are dropped. An answer whose hits were found twice goes out twice.
    """
    said = answers.select("query_id", "answer", "sent_at").withWatermark("sent_at", delay)
    found = hits.select(F.col("query_id").alias("__of"), "texts", "best", "found_at").withWatermark("found_at", delay)
    near = F.expr(f"__of = query_id and found_at between sent_at - interval {wait} and sent_at + interval {wait}")
    return check_stream(said.join(found, near, "left_outer"), params)
