"""A corpus pipeline: documents in, packed training sequences out.

Each stage judges every row that its predecessor kept: toxic documents go, then
those of poor quality, then all but one of each near-duplicate class, then
passages that an earlier document has; what is left is tokenised and packed.

Defined results: null and empty texts are judged like others (their scores decide)
and are near-duplicates of none; a row without an id is kept by the stages that
need one to tell documents apart; rows that share an id are one document where
repeats are cut; ties go to the smaller id; texts of any length are taken whole; an
empty table gives no rows. All columns of the documents pass through the first four
stages under their names and unchanged, whatever they are called, but for the text
and a column n_chars where passages were cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtables.llm import neardup, packing, sitequality, substrings, toxicity
from ragtables.llm.session import checkpointed


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sitequality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out("doc_id")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(docs, counts=("__words", "__removed"))
    if "n_chars" in docs.columns:  # the count follows the text
        cut = cut.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", without_poor),
    ("MinHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Models, alignments and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))  # later stages read it several times
    return STAGES[-1][1](spark, docs, sf_dir)
