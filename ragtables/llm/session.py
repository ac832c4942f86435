"""Where the operators cut lineage: the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
FEW = 20_000  # rows of grouped figures that are broadcast


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, so that a lost executor costs no recomputation of what led to it.

    The folder is the one that the cluster names; only where none is set in a local
    session, as in a test, a folder of this machine is taken.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ragtables-"))
    return df.checkpoint(eager=True)


def salted_join(rows: DataFrame, figures: DataFrame, keys: list[str], spread_by, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows beside the figures of their key. Rows of one key go to `salts` tasks, by spread_by; the figures are repeated for each."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    figures = figures.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(figures, [*keys, "__salt"], how).drop("__salt")


def beside_group(rows: DataFrame, figures: DataFrame, keys: list[str], spread_by, how: str = "inner") -> DataFrame:
    """The same for figures that are already made, one row per group: broadcast if they are counted to be few."""
    if figures.count() <= FEW:
        return rows.join(F.broadcast(figures), keys, how)
    return salted_join(rows, figures, keys, spread_by, how)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
