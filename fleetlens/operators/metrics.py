"""Metric samples: one long table of (server, poll, name, entity, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numeric import hit_ratio, round_up4
from fleetlens.operators.deltas import lag_pairs
from fleetlens.operators.rows import drop_nulls
from fleetlens.schemas import DB_COUNTERS, POLL, POLL_AT, REQUIRED, SERVER

METRIC = [*POLL_AT, "name", "entity", "value"]

# --- fixed values: metric names -------------------------------------------
DATABASE_METRICS = {
    "query.transactions.committed": "xact_commit",
    "query.transactions.rolledback": "xact_rollback",
    "query.rows.returned": "tup_returned",
    "query.rows.fetched": "tup_fetched",
    "query.rows.inserted": "tup_inserted",
    "query.rows.updated": "tup_updated",
    "query.rows.deleted": "tup_deleted",
    "query.conflicts": "conflicts",
    "query.deadlocks": "deadlocks",
    "disk.temp.files": "temp_files",
    "disk.temp.bytes": "temp_bytes",
    "disk.io.blocks.read": "blks_read",
    "disk.io.blocks.hit": "blks_hit",
    "disk.io.blocks.hit.percent": "blks_hit_percent",
    "disk.io.blocks.read.time": "blk_read_time",
    "disk.io.blocks.write.time": "blk_write_time",
}


def unpivot(rows: DataFrame, metrics: dict[str, Column], entity: Column | None = None) -> DataFrame:
    """One metric row per named value; a NULL value yields no row."""
    entity = F.lit("") if entity is None else entity
    items = F.array(
        *[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in metrics.items()]
    )
    return (
        rows.select(*POLL_AT, entity.alias("entity"), F.inline(items))
        .filter(F.col("value").isNotNull())
        .select(*METRIC)
    )


def setting_value(settings: DataFrame, name: str, alias: str, kind: str = "string") -> DataFrame:
    """One named setting per server poll, cast to a type; unreadable values drop out."""
    return (
        settings.filter(F.col("name") == name)
        .select(*POLL_AT, F.col("setting").try_cast(kind).alias(alias))
        .filter(F.col(alias).isNotNull())
    )


def connections_used(activity: DataFrame, settings: DataFrame) -> DataFrame:
    """Backends in use and reserved connections."""
    used = activity.groupBy(*POLL).agg(F.count(F.lit(1)).alias("used"))
    reserved = setting_value(settings, "superuser_reserved_connections", "reserved", "int")
    both = reserved.join(used, POLL, "left")
    return unpivot(
        both,
        {
            "connections.used": F.coalesce(F.col("used"), F.lit(0)),
            "connections.reserved": F.col("reserved"),
        },
    )


def database_delta(db_stats: DataFrame) -> DataFrame:
    """Change of the database counters against the last successful poll.

    Resets show as negative values; the first poll of a server emits nothing.
    """
    pairs = lag_pairs(drop_nulls(db_stats, REQUIRED["db_stats"]), SERVER, DB_COUNTERS)
    changed = pairs.filter(F.col("prev").isNotNull()).select(
        *POLL_AT, *[(F.col(c) - F.col(f"prev.{c}")).alias(c) for c in DB_COUNTERS]
    )
    changed = changed.withColumn("blks_hit_percent", hit_ratio(F.col("blks_hit"), F.col("blks_read")))
    return unpivot(
        changed,
        {name: F.col(c) for name, c in DATABASE_METRICS.items()},
        F.concat(F.lit("database/"), F.col("database")),
    )


def cache_hit_rates(index_statio: DataFrame, table_statio: DataFrame) -> DataFrame:
    """Share of block accesses served from cache, for indexes and tables.

    Defined over the product of both relations, where multiplicities cancel: each
    side is summed on its own and the inner join keeps the rule that an empty
    side gives no rate at all.
    """
    hit, read = F.col("idx_blks_hit"), F.col("idx_blks_read")
    index_rate = index_statio.groupBy(*POLL_AT).agg(
        F.try_divide(F.sum(hit).cast("double"), F.sum(hit + read).cast("double")).alias("index_rate")
    )
    hit, read = F.col("heap_blks_hit"), F.col("heap_blks_read")
    table_rate = table_statio.groupBy(*POLL).agg(
        F.try_divide(F.sum(hit).cast("double"), (F.sum(hit) + F.sum(read)).cast("double")).alias("table_rate")
    )
    return unpivot(
        index_rate.join(table_rate, POLL),
        {"cache.index.hit.rate": F.col("index_rate"), "cache.table.hit.rate": F.col("table_rate")},
    )


def append_rows(*frames: DataFrame) -> DataFrame:
    """Bag union; columns a frame lacks become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def metric_series(
    metrics: DataFrame, order: list[str] | None = None, by: list[str] | None = None, segment_seconds: int | None = None
) -> DataFrame:
    """Arrival-ordered (value, measured_at) lists per config name, metric and entity.

    A series needs a bound: columns to group by as well (``by``, a report window), or the length of its
    segments in seconds, which are numbered by ``segment`` from the epoch.
    """
    if not by and not segment_seconds:
        raise ValueError("a series over all history has no bound: name a window in by, or segment_seconds")
    if segment_seconds:
        metrics = metrics.withColumn("segment", F.floor(F.col("measured_at") / segment_seconds))
        by = [*(by or []), "segment"]
    order = order or ["measured_at", "poll_seq", *SERVER[1:], "value"]
    sample = F.struct(
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        round_up4(F.col("value")).alias("value"),
        F.col("measured_at").alias("measured_at"),
    )
    return metrics.groupBy(*by, "config_name", "name", "entity").agg(
        F.transform(
            F.sort_array(F.collect_list(sample)),
            lambda s: F.struct(s["value"].alias("value"), s["measured_at"].alias("measured_at")),
        ).alias("values")
    )
