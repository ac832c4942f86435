"""The streams (K) run over whole tables to their end, and what they have written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.store import ChunkStore
from ..sources.tables import shared_folder
from ..streaming import ingest
from ..streaming.memory import remember
from ..streaming.validation import check_answers, hit_messages
from . import answers as A
from . import dialogue as D
from . import inputs as I
from . import text as T

QUERIES, ORACLES, register = I.registry()
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, sf_dir, name):
    """A table as a stream of its files. A pattern for a path may stand for a folder or for a single file."""
    schema = I.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register(f"WITH {T.INGESTED} SELECT chunk_id, document_id, filename, chunk_index, page, text FROM chunks WHERE filename NOT LIKE '%.xls'")
def k1_streamed_ingest(spark, sf_dir):
    """The documents as a stream of pages, ingested, and the chunks that arrived."""
    out = shared_folder(spark, "ingested")
    ingest.start_ingest(I.as_pages(_stream(spark, sf_dir, "documents")), out, shared_folder(spark, "progress")).awaitTermination()
    return ChunkStore(spark, out).chunks().select("chunk_id", "document_id", "filename", "chunk_index", "page", "text")


@register(D.CONTEXTUALIZED)
def k2_streamed_memory(spark, sf_dir):
    """The conversations as a stream of turns, remembered as state, and the user turns that came out."""
    out, before = shared_folder(spark, "remembered"), spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # the only store that keeps such state
    try:
        rows = remember(_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), D.N)
        writer = rows.select("conv_id", "turn", "needs_context", "standalone").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "progress"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema("conv_id long, turn long, needs_context boolean, standalone string").parquet(out).select("conv_id", "turn", F.col("needs_context"), "standalone")


_LATE = "CAST(query_id AS BIGINT) % 9 = 4"


@register(
    f"""{A._CHECK} SELECT query_id, CASE WHEN {_LATE} THEN {A._q(A.REFUSAL)} ELSE answer || CASE WHEN passed THEN '' ELSE chr(10) || chr(10) || {A._DISC} END END AS answer,
  CASE WHEN {_LATE} THEN false ELSE passed END AS grounded FROM checked"""
)
def k3_checked_answers(spark, sf_dir):
    """Answers and hits as two streams of files that meet under watermarks, run to their end; the hits of every ninth answer never come."""
    said, found, out, marks = (shared_folder(spark, name) for name in ("answers", "hits", "checked", "progress"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("query_id").cast("long"), F.lit(0)))
    # the last rows of a stream go out when time goes on: here, by a row for nobody of a later day
    end = lambda *columns: spark.range(1).select(F.lit("").alias("query_id"), *columns)
    later = F.timestamp_seconds(F.lit(1_800_000_000))
    answers = I.answers(spark, sf_dir).withColumn("sent_at", at)
    answers.unionByName(end(F.lit("").alias("answer"), later.alias("sent_at"))).write.parquet(said)
    hits = hit_messages(I.hits(spark, sf_dir).where(f"not ({_LATE})"), at - F.expr("interval 5 seconds"))
    hits.unionByName(end(F.array().cast("array<string>").alias("texts"), F.lit(0.0).alias("best"), later.alias("found_at"))).write.parquet(found)
    streams = [spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) for path in (said, found)]
    rows = check_answers(*streams).select("query_id", "answer", "grounded")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
    query.processAllAvailable()  # with the batch without data in which the refusals go out
    query.stop()
    return spark.read.schema("query_id string, answer string, grounded boolean").parquet(out).where("query_id <> ''")  # a filter before would hide that time goes on
