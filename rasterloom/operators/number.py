"""Consecutive numbers for rows in an order, without moving all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.shared import settle


def numbered_rows(df: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... by ``order`` (nulls first; ties in any order).

    Rows are ranged by ``order`` and sorted within their ranges; a row's number is its place in its
    range plus the sizes of the ranges before.  Only one number per range reaches the driver.  The
    ranges are checkpointed, so that sizes and places come from the same rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    placed = settle(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, bases = start, []
    for row in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        bases.append((row["_range"], before))
        before += row["n"]
    base = F.create_map(*(F.lit(x) for pair in bases for x in pair))[F.col("_range")] if bases else F.lit(start)
    return placed.withColumn(name, (base + F.col("_place")).cast("long")).drop("_range", "_place")
