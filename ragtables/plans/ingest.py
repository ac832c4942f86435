"""Documents in, embedded chunks and catalogue rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, chunking, dedup, search
from ..params import Params
from ..sources.tables import checkpointed


def chunk_table(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Cleaned, packed, numbered chunks without repeats inside a document."""
    return dedup.drop_duplicate_chunks(chunking.number_chunks(chunking.chunk_pages(pages, params.chunk_size, params.chunk_overlap)))


def ingest(pages: DataFrame, params: Params = Params(), *, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with vectors, registry rows without upload time, rejects) of pages (document_id, filename, page, text).

    Every text is cleaned once: a document without text is one of which no chunk came.
    """
    usable, rejects = catalog.split_by_type(pages)
    chunks = checkpointed(chunk_table(usable, params))  # read for the vectors, the registry and the rejects
    names = usable.select("document_id", "filename").distinct()
    registry = chunking.document_stats(chunks).join(names, "document_id").select(F.col("document_id").alias("id"), "filename", "num_chunks", "num_chars")
    empty = catalog.without_chunks(names, chunks)
    return search.embed(chunks, "text", encoder, dim=params.dim), registry, rejects.unionByName(empty)
