"""Documents, evaluation sets and reports as files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = (".txt", ".md")
_NAME = r"([^/]+)$"

PAGES = "document_id string, filename string, page int, text string"


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def decode_text(content):
    """UTF-8 bytes as text; what is no UTF-8 is dropped.

    A replacement character that the file itself has is spelt otherwise, until those of the repair are gone.
    """
    text, spelt = content.cast("string"), (("\ufdd0", "\ufdd0a"), ("\ufffd", "\ufdd0b"))
    for plain, other in spelt:
        text = F.replace(text, F.lit(plain), F.lit(other))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    for plain, other in spelt[::-1]:
        text = F.replace(text, F.lit(other), F.lit(plain))
    return text


def text_pages(files: DataFrame) -> DataFrame:
    """One page without number per text or markdown file of a binaryFile table."""
    rows = files.where(_suffix(F.col("path")).isin(*TEXT_SUFFIXES))
    return rows.select(F.sha2(F.col("path").cast("binary"), 256).alias("document_id"), F.regexp_extract("path", _NAME, 1).alias("filename"), F.lit(None).cast("int").alias("page"), decode_text(F.col("content")).alias("text"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    return text_pages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_pages(df: DataFrame, extractor: Callable | None = None) -> DataFrame:
    """Pages 1..n. df: a table of pages (null texts become empty), or binaryFile rows for a caller's extractor.

    extractor: file bytes -> iterable of page texts; it runs once per file inside the tasks.
    """
    if extractor is None:
        return df.select("document_id", "filename", "page", F.coalesce("text", F.lit("")).alias("text"))

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, name, content in batch.itertuples(index=False):  # a file at a time: its pages are the output
                texts = [t or "" for t in extractor(bytes(content))]
                yield pd.DataFrame({"document_id": document, "filename": name, "page": range(1, len(texts) + 1), "text": texts})

    files = df.select(F.sha2(F.col("path").cast("binary"), 256).alias("document_id"), F.regexp_extract("path", _NAME, 1).alias("filename"), "content")
    return files.mapInPandas(pages, PAGES)


_WORDS = T.ArrayType(T.StringType())
CASE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("query", T.StringType()),
        T.StructField("relevant_keywords", _WORDS), T.StructField("expected_answer_keywords", _WORDS), T.StructField("forbidden_answer_keywords", _WORDS),
        T.StructField("should_refuse", T.BooleanType()), T.StructField("document_filenames", _WORDS), T.StructField("expected_source_filenames", _WORDS),
        T.StructField("top_k", T.IntegerType()), T.StructField("mode", T.StringType()),
    ]
)


def with_case_defaults(cases: DataFrame) -> DataFrame:
    """Missing lists empty, should_refuse false, mode auto."""
    none = F.array().cast(_WORDS)
    lists = {f.name: F.coalesce(f.name, none) for f in CASE if isinstance(f.dataType, T.ArrayType)}
    return cases.withColumns(lists | {"should_refuse": F.coalesce("should_refuse", F.lit(False)), "mode": F.coalesce("mode", F.lit("auto"))})


def read_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON file {name, cases: [...]}: dataset, position in the file, and the columns of CASE."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("cases", T.ArrayType(CASE))])
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return with_case_defaults(rows.select(F.coalesce("name", F.lit("rag-eval")).alias("dataset"), F.posexplode("cases").alias("position", "c")).select("dataset", "position", "c.*"))


def nested_report(report: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: the report's columns and `cases`, its case metrics as a list by case_id. For sets of labelled questions."""
    rows = cases.agg(F.array_sort(F.collect_list(F.struct("case_id", *[c for c in cases.columns if c != "case_id"]))).alias("cases"))
    return report.join(F.broadcast(rows))


def write_report(report: DataFrame, cases: DataFrame, path: str) -> None:
    nested_report(report, cases).coalesce(1).write.mode("overwrite").json(path)
