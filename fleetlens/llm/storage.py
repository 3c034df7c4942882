"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.workspace import workspace


#: Tables written between two clean-ups of the driver.
RELEASE_EVERY = 3
_written = [0]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors share; raises where none is configured."""
    return workspace(spark, f"llm-{purpose}")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.option("compression", "zstd").parquet(path)
    # What is written down needs neither its plan nor its shuffles any more; many small steps would pile them up.
    _written[0] += 1
    if _written[0] % RELEASE_EVERY == 0:
        release(spark)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of partitions, for steps whose work the size of their rows does not show."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by this module once nothing reads it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored.

    Spark removes them when the driver collects its garbage, which a driver with little to do may not
    do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
