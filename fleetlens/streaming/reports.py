"""Reports over streams: each interval once, as soon as every stream has passed it.

A micro-batch is first staged, then the intervals that the watermark has passed are read back from
the staged batches, built by an ordinary batch function and written, and last an entry of one row
commits the batch.  Every step overwrites the folder of its own batch, so a batch that Spark repeats
after a failure writes nothing twice, and a batch whose entry exists is left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.metrics import append_rows

ENTRY = "closed long, latest map<string, long>, open array<struct<batch: long, last: long>>, received long, behind long"


def _interval(at: Column, seconds: int) -> Column:
    return (F.floor(F.unix_seconds(at) / seconds) * seconds).cast("long")


def together(streams: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Several streams as one: ``_kind``, the event time ``_at``, and a struct column per stream."""
    tagged = [
        rows.select(F.lit(kind).alias("_kind"), F.col(at).cast("timestamp").alias("_at"), F.struct("*").alias(kind))
        for kind, (rows, at) in streams.items()
    ]
    return append_rows(*tagged)


def _entry(spark: SparkSession, base: str, number: int):
    """The commit entry of a batch; None where it was not (wholly) written."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{base}/entries/batch={number}").first()
    except AnalysisException:
        return None


def _rows_of(staged: DataFrame, kind: str) -> DataFrame:
    return staged.filter(F.col("_kind") == kind).select(f"{kind}.*")


def report_batches(
    base: str, kinds: Mapping[str, object], build: Callable[[dict[str, DataFrame]], DataFrame],
    delay_seconds: int, interval_seconds: int = 60,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of :func:`stream_reports`."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _entry(spark, base, number) is not None:
            return
        before = _entry(spark, base, number - 1) if number else None
        closed = before.closed if before else None
        latest, waiting = (dict(before.latest), list(before.open)) if before else ({}, [])

        folder = f"{base}/staged/batch={number}"
        start = _interval(F.col("_at"), interval_seconds)
        late = F.col("_start").isNull() | F.coalesce(F.col("_start") < F.lit(closed).cast("long"), F.lit(False))
        batch.withColumn("_start", start).withColumn("_behind", late).write.mode("overwrite").parquet(folder)
        staged = spark.read.parquet(folder)
        facts = staged.groupBy("_kind").agg(
            F.max(F.unix_seconds("_at")).alias("latest"), F.count(F.lit(1)).alias("n"),
            F.count_if("_behind").alias("behind"), F.max(F.when(~F.col("_behind"), F.col("_start"))).alias("last"),
        ).collect()  # one row per stream
        for fact in facts:
            if fact.latest is not None:
                latest[fact["_kind"]] = max(latest.get(fact["_kind"], fact.latest), fact.latest)
        lasts = [fact["last"] for fact in facts if fact["last"] is not None]
        waiting += [(number, max(lasts))] if lasts else []

        until = closed
        if all(kind in latest for kind in kinds):
            passed = (min(latest.values()) - delay_seconds) // interval_seconds * interval_seconds
            until = passed if closed is None else max(closed, passed)
        if until is not None and until != closed and waiting:
            held = spark.read.schema(staged.schema).parquet(*[f"{base}/staged/batch={n}" for n, _ in waiting])
            ready = held.filter(~F.col("_behind") & (F.col("_start") < until))
            if closed is not None:
                ready = ready.filter(F.col("_start") >= closed)
            build({kind: _rows_of(ready, kind) for kind in kinds}).write.mode("overwrite").parquet(f"{base}/reports/batch={number}")
        waiting = [(n, last) for n, last in waiting if until is None or last >= until]
        entry = (until, latest, waiting, sum(f.n for f in facts), sum(f.behind for f in facts))
        spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{base}/entries/batch={number}")

    return run


def stream_reports(
    streams: Mapping[str, tuple[DataFrame, str]], build: Callable[[dict[str, DataFrame]], DataFrame],
    base: str, delay_seconds: int, interval_seconds: int = 60,
):
    """A stream writer that builds the reports of every interval that all streams have passed.

    ``streams`` maps a name to a stream and its event time column; ``build`` gets the rows of whole
    intervals under the same names, as batch frames, and returns the reports.  Rows may come
    ``delay_seconds`` later than the latest of their stream; the slowest stream decides, and a stream
    that has sent nothing holds every interval open.  Rows of an interval that is reported, and rows
    without a time, stay staged, marked ``_behind``, and are counted in the entry of their batch.
    An interval is read again only from the batches that hold rows of open intervals.
    """
    run = report_batches(base, streams, build, delay_seconds, interval_seconds)
    return together(streams).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint")


def reports(spark: SparkSession, base: str) -> DataFrame:
    """All reports so far, from committed batches."""
    done = spark.read.schema(ENTRY + ", batch long").option("basePath", f"{base}/entries").parquet(f"{base}/entries/batch=*")
    found = spark.read.option("basePath", f"{base}/reports").parquet(f"{base}/reports/batch=*")
    return found.join(done.select(F.col("batch")), "batch", "left_semi").drop("batch")


def rows_behind(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Rows of a stream that came after the report of their interval."""
    return _rows_of(spark.read.parquet(f"{base}/staged/batch=*").filter("_behind"), kind)


def rows_received(spark: SparkSession, base: str) -> DataFrame:
    """``batch, received, behind`` of every committed batch."""
    entries = spark.read.schema(ENTRY + ", batch long").option("basePath", f"{base}/entries").parquet(f"{base}/entries/batch=*")
    return entries.select("batch", "received", "behind")


def report_all(spark: SparkSession, writer) -> None:
    """Everything that has arrived, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
