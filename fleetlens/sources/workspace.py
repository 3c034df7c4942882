"""Folders for intermediate and staged data that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Set by ``ensure_shared`` where the session has no ``spark.checkpoint.dir``.
SHARED = "spark.fleetlens.shared.dir"


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared directory of the session; raises where none is configured."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/fleetlens-{purpose}-{uuid.uuid4().hex}"


def ensure_shared(spark: SparkSession) -> None:
    """Where the cluster names no checkpoint directory, use a folder beside the session's warehouse."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None)):
        spark.conf.set(SHARED, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")


#: Partitions that a shuffle starts with where adaptive execution merges small ones: a number that grows
#: with nothing bounds what one task sorts only if it is large.
FINE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FINE_PARTITIONS = "1000"


#: Bytes of a file that one task reads: written steps are compressed several times as much as a shuffle.
SCAN = "spark.sql.files.maxPartitionBytes"
SCAN_DEFAULT, FINE_SCAN = str(128 << 20), str(32 << 20)


def fine_shuffles(spark: SparkSession, on: bool = True) -> None:
    """Let shuffles and scans start in many small partitions, or as the session has it; a number set by others stays."""
    size = spark.conf.get(SCAN, SCAN_DEFAULT).removesuffix("b")
    if size == (SCAN_DEFAULT if on else FINE_SCAN):
        spark.conf.set(SCAN, FINE_SCAN if on else SCAN_DEFAULT)
    now = spark.conf.get(FINE, None)
    if on and now is None:
        spark.conf.set(FINE, FINE_PARTITIONS)
    elif not on and now == FINE_PARTITIONS:
        spark.conf.unset(FINE)


#: Whether Spark deletes the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def land(frame: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write a frame to a shared folder; its shuffle files go when it is written."""
    with shuffles_dropped(frame.sparkSession):
        frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def landed(frame: DataFrame, purpose: str, rows_per_file: int = 0) -> DataFrame:
    """The frame written to a folder of its own and read back: what several steps read is derived once.

    A reader holds some thousand rows of a file at once; ``rows_per_file`` bounds that where rows are long.
    """
    path = workspace(frame.sparkSession, purpose)
    land(frame, path, rows_per_file)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
