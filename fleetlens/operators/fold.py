"""Latest-wins folding of what accumulates within a report interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.schemas import SERVER

# --- fixed values ------------------------------------------------------------
REPORT_INTERVAL = "60 seconds"
ERROR_LIMIT = 10


def _last_where(value: str, usable: Column, order: str) -> Column:
    return F.max_by(F.when(usable, F.col(value)), F.when(usable, F.col(order)))


def fold_servers(records: DataFrame, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """One row per server: latest time, last usable version and limit, first platform and pooler."""
    return records.groupBy(*by, "config_name", "config_var_name").agg(
        F.max_by("monitored_at", order).alias("monitored_at"),
        F.coalesce(_last_where("version", F.col("version") != "", order), F.lit("")).alias("version"),
        F.coalesce(
            _last_where("max_connections", F.col("max_connections") != 0, order), F.lit(0).cast("bigint")
        ).alias("max_connections"),
        F.min_by("platform", order).alias("platform"),
        F.min_by("pooler", order).alias("pooler"),
    )


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of every key; combines partially before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_last")).select(
        *keys, "_last.*"
    )


def latest_poll(rows: DataFrame, keys: Sequence[str] = SERVER, poll: str = "poll_seq") -> DataFrame:
    """All rows of the last poll of every key (a flat tree or list replaced as a whole).

    The rank filter also runs before the shuffle, so a long history sends only
    its latest rows.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(poll))
    return rows.withColumn("_rank", F.rank().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def latest_settings(settings: DataFrame, order: str = "poll_seq") -> DataFrame:
    return latest(settings, [*SERVER, "name"], order)


def report_window(rows: DataFrame, event_time: str, interval: str = REPORT_INTERVAL) -> DataFrame:
    """Rows with the start of their tumbling report interval."""
    return rows.withColumn("report_start", F.window(F.col(event_time), interval)["start"])


def error_cap(
    errors: DataFrame,
    interval: str = REPORT_INTERVAL,
    limit: int = ERROR_LIMIT,
    by: Sequence[str] = (),
) -> DataFrame:
    """The first errors of every report interval, plus the first panic.

    The first ``limit`` of each kind suffice to decide, and that rank filter runs
    before the shuffle: an interval full of errors sends a handful per task.
    """
    windowed = report_window(errors, "event_time", interval)
    per_kind = Window.partitionBy(*by, "report_start", "panic").orderBy("seq")
    few = windowed.withColumn("_of_kind", F.row_number().over(per_kind)).filter(F.col("_of_kind") <= limit)
    rank = F.row_number().over(Window.partitionBy(*by, "report_start").orderBy("seq"))
    return (
        few.withColumn("_rank", rank)
        .filter((F.col("_rank") <= limit) | (F.col("panic") & (F.col("_of_kind") == 1)))
        .drop("_rank", "_of_kind")
    )


def collector_log_stats(
    payloads: DataFrame, interval: str = REPORT_INTERVAL, by: Sequence[str] = ()
) -> DataFrame:
    """Counts over log processing per report interval.

    Counted inside each payload first, so the shuffle carries partial sums only.
    """
    from fleetlens.functions.logtext import slow_query_line
    from fleetlens.operators.logs import is_metric_line, is_sql_line, mentions_postgres, stitched_lines

    handled = mentions_postgres(F.col("body"))
    parsed = payloads.withColumn("_handled", handled).withColumn(
        "_lines", F.when(F.col("_handled"), stitched_lines(F.col("body")))
    )

    def lines(keep) -> Column:
        return F.coalesce(F.size(F.filter("_lines", keep)), F.lit(0))

    counted = parsed.select(
        *by,
        "received_at",
        F.col("_handled").cast("bigint").alias("postgres"),
        F.when(F.col("_handled"), lines(lambda x: is_metric_line(x["process"]))).otherwise(0).alias("metric_lines"),
        F.when(
            F.col("_handled"),
            lines(lambda x: is_sql_line(x["process"]) & slow_query_line(x["message"]).isNotNull()),
        ).otherwise(0).alias("slow_queries"),
    )
    return (
        report_window(counted, "received_at", interval)
        .groupBy(*by, "report_start")
        .agg(
            F.count(F.lit(1)).alias("received"),
            F.sum("postgres").alias("postgres"),
            F.sum(F.col("metric_lines") + F.col("slow_queries")).cast("bigint").alias("handled"),
            F.sum("metric_lines").cast("bigint").alias("metric_lines"),
            F.sum("slow_queries").cast("bigint").alias("slow_queries"),
        )
    )
