"""The document catalogue: rejects, deletion, replacement, upsert, listing, scopes, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text

SUFFIXES = (".pdf", ".txt", ".md")


def _supported(suffixes: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)).isin(*suffixes), F.lit(False))


def split_by_type(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Pages of files that can be read, and (document_id, filename, reason) of the others. No text is looked at."""
    other = pages.where(~_supported(suffixes)).select("document_id", "filename").distinct()
    return pages.where(_supported(suffixes)), other.select("document_id", "filename", F.lit("unsupported type").alias("reason"))


def split_rejects(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Pages of usable documents, and (document_id, filename, reason) of the others."""
    whole = pages.groupBy("document_id", "filename").agg(F.max(F.length(clean_text(F.coalesce("text", F.lit(""))))).alias("longest"))
    reason = F.when(~_supported(suffixes), "unsupported type").when(F.col("longest") == 0, "no text")
    rejects = whole.select("document_id", "filename", reason.alias("reason")).where("reason is not null")
    return pages.join(rejects.select("document_id", "filename"), ["document_id", "filename"], "left_anti"), rejects


def without_chunks(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (document_id, filename) of which there is no chunk, as rejects."""
    empty = names.join(chunks.select("document_id"), "document_id", "left_anti")
    return empty.select("document_id", "filename", F.lit("no text").alias("reason"))


def delete_documents(chunks: DataFrame, registry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and registry without the documents of ids (document_id), and per id: existed, removed chunks."""
    ids = ids.select("document_id").distinct()
    counts = chunks.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("removed"))
    known = registry.select(F.col("id").alias("document_id"), F.lit(True).alias("existed")).distinct()
    report = ids.join(counts, "document_id", "left").join(known, "document_id", "left").select("document_id", F.coalesce("existed", F.lit(False)).alias("existed"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))
    gone = ids.withColumnRenamed("document_id", "id")
    return chunks.join(ids, "document_id", "left_anti"), registry.join(gone, "id", "left_anti"), report


def replace_by_filename(registry: DataFrame, chunks: DataFrame, new_registry: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and chunks in which the new documents stand for earlier ones of the same file name."""
    names = new_registry.select("filename").distinct()
    old = registry.join(names, "filename", "left_semi").select(F.col("id").alias("document_id")).distinct()
    kept = registry.join(names, "filename", "left_anti").select(*registry.columns)
    return kept.unionByName(new_registry), chunks.join(old, "document_id", "left_anti").select(*chunks.columns).unionByName(new_chunks)


def upsert_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """One row per id: the newest by uploaded_at, new rows before old ones of the same time."""
    rows = registry.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = rows.groupBy("id").agg(F.max_by(F.struct(*registry.columns), F.struct("uploaded_at", "__new")).alias("r"))
    return best.select("r.*")


def list_documents(registry: DataFrame) -> DataFrame:
    """Documents newest first, each with the total number."""
    total = registry.agg(F.count("*").alias("total"))
    return registry.join(F.broadcast(total)).orderBy(F.desc("uploaded_at"), "id")  # one row


def resolve_document_ids(cases: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, document_ids) in the order of document_filenames, and (case_id, missing) where names are unknown.

    The last document added under a name counts: by uploaded_at, then id.
    """
    latest = registry.groupBy("filename").agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("document_id"))
    names = cases.select(F.col("id").alias("case_id"), F.posexplode("document_filenames").alias("pos", "filename"))
    found = names.join(latest, "filename", "left")
    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("document_id").isNotNull(), F.struct("pos", "document_id")))), lambda x: x["document_id"])
    ids = found.groupBy("case_id").agg(in_order.alias("document_ids"))
    missing = found.where("document_id is null").groupBy("case_id").agg(F.array_sort(F.collect_set("filename")).alias("missing"))
    return ids, missing


def check_scope(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, missing): the unknown document ids of scoped queries. Null or empty scopes name no document."""
    asked = queries.select("query_id", F.explode("scope").alias("document_id")).distinct()
    unknown = asked.join(registry.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return unknown.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("document_id")), ", ").alias("missing"))


def corpus_health(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, chunked_documents."""
    return registry.agg(F.count("*").alias("documents")).join(F.broadcast(chunks.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("chunked_documents"))))


def in_reading_order(chunks: DataFrame) -> DataFrame:
    """chunks with their position in the corpus order of each document."""
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")))
