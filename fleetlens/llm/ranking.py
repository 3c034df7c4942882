"""Exact ranks of a whole table without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import shuffle_partitions, stored


def ranked(frame: DataFrame, order: list[Column], group: str | None = None, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0, per non-null value of ``group`` if named) and the ``size`` of the group.

    The rows are range-partitioned and sorted in place, so a group may span any number of tasks; the
    rank is the place in the partition plus the rows of the group in partitions before it.  Rows that
    agree in all of ``order`` are told apart by where they were read, which also splits them over
    partitions.  Only one count per group and partition is summed up.
    """
    spark = frame.sparkSession
    by = [F.col(group)] if group else []
    numbered = frame.withColumn("_read", F.monotonically_increasing_id())
    keys = [*by, *order, F.col("_read")]
    placed = stored(
        numbered.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .drop("_read")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranked",
    )
    on = ([group] if group else []) + ["_part"]
    counts = placed.groupBy(*on).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    added = [(F.col("_before") + F.col("_place") - F.col("_first")).alias(rank)]
    if size:
        offsets = offsets.withColumn("_all", F.sum("_rows").over(whole))
        added.append(F.col("_all").alias(size))
    return placed.join(offsets, on).select(*frame.columns, *added)
