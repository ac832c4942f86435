"""Chunk tables as Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, document_id string, filename string, chunk_index int, page int, text string, vector array<double>"
BUCKETS = 64


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def write_chunks(chunks: DataFrame, path: str, *, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Parquet by a bucket of document_id, so that a change of documents rewrites their buckets only."""
    chunks.withColumn("bucket", bucket_of(F.col("document_id"), buckets)).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS + ", bucket int").parquet(path).drop("bucket")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base or tempfile.mkdtemp(prefix="ragtables-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written below the shared folder: made once, and not again for each of its readers or after a lost executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)
