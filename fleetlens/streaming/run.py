"""Running streams to completion and windowed reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.fold import REPORT_INTERVAL
from fleetlens.sources.workspace import workspace
from fleetlens.streaming.state import ROCKSDB



def drain(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Process everything that has arrived, into parquet, and read the result."""
    base = workspace(spark, purpose)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(
    rows: DataFrame, event_time: str, keys: list[str], watermark: str, interval: str = REPORT_INTERVAL
) -> DataFrame:
    """Rows per report interval and key over a stream with late data.

    Rows later than ``watermark`` are left out; the progress of the query counts them
    (``numRowsDroppedByWatermark``).
    """
    return (
        rows.withWatermark(event_time, watermark)
        .groupBy(F.window(event_time, interval), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("report_start"), *keys, "n")
    )


def each_batch(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str):
    """Run a batch function on every micro-batch (reports and their sink).

    The batch is cached while it is handled, as a report reads it several times.
    """

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            handle(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
