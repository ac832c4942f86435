"""Chunks of pages: sentence packing, numbering, identity, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, split_sentences
from ..sources.tables import checkpointed
from .numbering import numbered

FEW = 100_000  # starts that are broadcast once they are counted


def hard_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `size - overlap` behind the last."""
    step = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def _tail(sentences: list[str], overlap: int) -> list[str]:
    kept, used = [], 0
    for s in reversed(sentences):
        if used + len(s) > overlap:
            break
        kept.append(s)
        used += len(s) + 1
    return kept[::-1]


def _packed(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of one page. The carried tail is not measured against the size again, so a chunk may exceed it a little."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        nonlocal held
        out.append(" ".join(held))
        held = _tail(held, overlap)

    for s in sentences:
        if len(s) > size:
            if held:
                close()
            out.extend(s[i : i + size] for i in range(0, len(s), size - overlap))
        else:
            if held and sum(map(len, held)) + len(held) + len(s) + 1 > size:
                close()
            held.append(s)
    if held:
        close()
    return out


def chunk_pages(pages: DataFrame, chunk_size: int = 800, chunk_overlap: int = 120) -> DataFrame:
    """pages with `chunks`, the packed texts of each cleaned page; blank pages are left out. Pages are packed alone."""
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")

    @F.pandas_udf("array<string>")
    def pack(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda x: _packed(list(x), chunk_size, chunk_overlap))

    cleaned = pages.withColumn("text", clean_text(F.col("text"))).where("text <> ''")
    return cleaned.select("document_id", "filename", "page", pack(split_sentences(F.col("text"))).alias("chunks"))


def number_chunks(packed: DataFrame) -> DataFrame:
    """One row per chunk with a running chunk_index over the pages of its document.

    Pages come in order of their number, null ones as page 0, then by file name and content; pages that share all of
    these are numbered one after the other. What is sorted are counts by row, in ranges that may split a document; texts
    are shuffled once, by row, and only if many documents have more than one page.
    """
    page = F.coalesce("page", F.lit(0))
    rows = checkpointed(packed).withColumn("__row", F.monotonically_increasing_id())  # stable, as the rows are written
    slim = rows.select("__row", "document_id", page.alias("page0"), "filename", F.xxhash64("chunks").alias("content"), F.size("chunks").cast("long").alias("n"))
    several = slim.groupBy(F.col("document_id").alias("__several")).count().where("count > 1")
    slim = slim.join(several, F.col("document_id").eqNullSafe(F.col("__several")), "left_semi")
    order = [F.col(c).asc_nulls_first() for c in ("page0", "filename", "content", "__row")]
    starts = checkpointed(numbered(slim, order, within=("document_id",), sums={"start": "n"}).select("__row", "start"))
    rows = rows.join(F.broadcast(starts) if starts.count() <= FEW else starts, "__row", "left")
    rows = rows.select("document_id", "filename", "page", F.coalesce("start", F.lit(0)).alias("start"), F.posexplode("chunks").alias("pos", "text"))
    return with_chunk_id(rows.select("document_id", "filename", (F.col("start") + F.col("pos")).cast("int").alias("chunk_index"), "page", "text"))


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), *[c for c in chunks.columns if c != "chunk_id"])


def document_stats(chunks: DataFrame) -> DataFrame:
    """num_chunks and num_chars of each document."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("num_chunks"), F.sum(F.length("text")).cast("long").alias("num_chars"))
