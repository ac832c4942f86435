"""Continuous ingest: new pages become chunks, catalogue rows and rejects of a stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..plans.ingest import ingest
from ..sources.store import ChunkStore

COMPACT_EVERY = 16


def start_ingest(pages: DataFrame, path: str, checkpoint: str, params: Params = Params(), *, available_now: bool = True, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Merges every batch of pages into the store at path, by document: what comes later stands for what came before.

    A batch is one more run of the buckets that it touches, and the table changes at the swap of its manifest, which also
    names the batch: one that is run again after a failure is left out if it had come that far, and else written whole.
    Every compact_every batches the buckets of several runs become one run each, so reads stay as they are however many
    batches have passed. All pages of a document must come in one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = ChunkStore(batch.sparkSession, path)
        if not store.has_batch(number):
            held = batch.persist()
            chunks, registry, rejects = ingest(held, params)
            store.append(chunks, registry.withColumn("uploaded_at", F.current_timestamp()), rejects, batch=number)
            held.unpersist()
        if (number + 1) % compact_every == 0:
            store.compact()

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
