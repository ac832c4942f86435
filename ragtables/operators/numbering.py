"""Running numbers and running sums over whole tables: sort by ranges, then add what came before each range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

FEW = 20_000  # offsets that are broadcast once they are counted
_PART = 33  # monotonically_increasing_id has the partition above these bits


def numbered(rows: DataFrame, order: list[Column], *, within: tuple[str, ...] = (), name: str = "number", sums: dict[str, str] | None = None) -> DataFrame:
    """rows with `name`, 0, 1, 2... in the given order inside each group of the columns `within`.

    sums: for a result column the integer column of which it is the sum over all rows before, in the same order and group.

    The rows are dealt by ranges of (within, order) and sorted where they are, so no task holds a group: one of any size
    spreads over as many ranges as it fills. What each range adds to its groups (one row per range and group) gives the
    offsets. The order must tell rows apart; rows that it does not are interchangeable, or their numbers are arbitrary.
    Rows should be slim: they are written and read once.
    """
    spark, sums = rows.sparkSession, sums or {}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c).asc_nulls_first() for c in within), *order]
    dealt = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    at = dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", _PART).cast("int"))
    totals = [F.sum(c).alias(f"__t_{out}") for out, c in sums.items()]
    ranges = checkpointed(at.groupBy(*within, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), *totals))
    # a group has at most one row for each range here
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*(F.col(c).alias(f"__k_{c}") for c in within), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *(F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__b_{out}") for out in sums))
    same = reduce(lambda a, b: a & b, [F.col("__part") == F.col("__p"), *(F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in within)])
    found = at.join(F.broadcast(offsets) if ranges.count() <= FEW else offsets, same)
    found = found.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first"))
    if sums:
        inside = Window.partitionBy("__part", *within).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumns({out: F.col(f"__b_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in sums.items()})
    return found.select(*rows.columns, name, *sums)
