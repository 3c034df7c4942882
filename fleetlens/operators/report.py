"""Nested report documents.

A document belongs to one collector and one report interval (``by``).  Children are
aggregated per server before they join their parent, so the widest group is what
one collector saw in one interval, whatever the size of the fleet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numeric import round_up2
from fleetlens.operators.metrics import metric_series
from fleetlens.schemas import BLOCK_COUNTERS, POLL_AT

BY = ("collector_id", "report_start")


# ---- empty values -------------------------------------------------------------


def omit_zero(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def omit_blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def omit_false(value: Column) -> Column:
    return F.when(value, F.lit(True))


def omit_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def yes_no(value: Column) -> Column:
    """YES is true; NO and NULL are false."""
    return F.coalesce(value == "YES", F.lit(False))


def column_fields(c) -> list[Column]:
    """Report fields of a table column; ``c`` maps a name to a Column."""
    return [
        omit_blank(c("name")).alias("name"),
        omit_blank(c("default")).alias("default"),
        omit_blank(c("type")).alias("type"),
        omit_false(yes_no(c("nullable"))).alias("nullable"),
        omit_zero(c("max_length")).alias("max_length"),
        omit_zero(c("precision")).alias("precision"),
        omit_zero(c("scale")).alias("scale"),
        omit_blank(c("interval_type")).alias("interval_type"),
        omit_false(yes_no(c("is_identity"))).alias("is_identity"),
    ]


def table_counters(tables: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """Columns of a table that a report shows beside its name."""
    return [c for c in tables.columns if c not in (*keys, *POLL_AT, "schema", "name")]


def table_fields(c, counters: Sequence[str]) -> list[Column]:
    return [c("name").alias("name"), *[omit_zero(c(n)).alias(n) for n in counters]]


def index_fields(c) -> list[Column]:
    counts = ["bytes", "bytes_total", "bloat_bytes", "bloat_bytes_total", "bloat_factor", "scans",
              "blocks_read", "blocks_hit"]
    return [
        *[c(n).alias(n) for n in ("name", "unique", "unused", "valid")],
        *[omit_zero(c(n)).alias(n) for n in counts],
        omit_blank(c("definition")).alias("definition"),
    ]


def setting_fields(c) -> list[Column]:
    texts = ["name", "value", "unit", "category", "description", "context", "var_type", "source",
             "min_val", "max_val", "enum_vals", "boot_val", "reset_val"]
    return [*[omit_blank(c(n)).alias(n) for n in texts], c("pending_restart").alias("pending_restart")]


def replica_client_fields(c) -> list[Column]:
    """Addresses, host names and ports are left out on purpose."""
    return [
        omit_blank(c("application_name")).alias("application_name"),
        omit_zero(F.unix_seconds(c("backend_start"))).alias("backend_start"),
        omit_zero(c("backend_xmin")).alias("backend_xmin"),
        omit_blank(c("state")).alias("state"),
        F.coalesce(c("sync_priority"), F.lit(0)).alias("sync_priority"),
        omit_blank(c("sync_state")).alias("sync_state"),
    ]


_QUERY_TIMES = {
    "total_time": "time", "mean_time": "mean_time", "min_time": "min_time", "max_time": "max_time",
    "blk_read_time": "block_read_time", "blk_write_time": "block_write_time",
    "total_blk_io_time": "block_total_time",
}


def query_fields(c) -> list[Column]:
    """Report fields of a statement; times are rounded up to two places."""
    blocks = [omit_zero(c(b)).alias(b.replace("_blks_", "_blocks_")) for b in BLOCK_COUNTERS]
    return [
        omit_blank(c("database")).alias("database"),
        omit_zero(c("query_id")).alias("query_id"),
        *[omit_blank(c(n)).alias(n) for n in ("fingerprint", "query", "comment", "explain")],
        omit_zero(c("calls")).alias("calls"),
        *[omit_zero(round_up2(c(source))).alias(name) for source, name in _QUERY_TIMES.items()],
        omit_zero(c("rows")).alias("rows"),
        *blocks,
        omit_zero(c("measured_at")).alias("measured_at"),
    ]


def error_fields(c) -> list[Column]:
    return [
        omit_blank(c("error")).alias("error"),
        omit_false(c("panic")).alias("panic"),
        omit_blank(c("stack_trace")).alias("stack_trace"),
    ]


# ---- children per server ---------------------------------------------------------


def _list(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: list[Column], name: str) -> DataFrame:
    """Array of structs per key, in a fixed order."""
    ranked = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("_v"))
    return rows.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(ranked)), lambda x: x["_v"]).alias(name)
    )


def server_children(
    databases: DataFrame,
    replicas_self: DataFrame,
    replica_clients: DataFrame,
    metrics: DataFrame,
    queries: DataFrame,
    settings: DataFrame,
    by: Sequence[str] = BY,
) -> list[DataFrame]:
    """What hangs on a server, one row per config name each; ``databases`` holds one nested ``schemas`` array per database."""
    keys = [*by, "config_name"]
    return [
        _list(databases, keys, ["database"],
              [F.col("database").alias("name"), F.coalesce(F.col("schemas"), F.array()).alias("schemas")],
              "databases"),
        replicas_self.groupBy(*keys).agg(
            F.max_by(
                F.struct(
                    omit_blank(F.col("application_name")).alias("application_name"),
                    omit_blank(F.col("primary_config_name")).alias("primary_config_name"),
                    omit_blank(F.col("status")).alias("status"),
                ),
                F.struct("database", "poll_seq"),
            ).alias("replica")
        ),
        _list(replica_clients, keys, ["poll_seq", "ord"], replica_client_fields(F.col), "replicas"),
        _list(
            metric_series(metrics, by=list(by)).withColumn("entity", omit_blank(F.col("entity"))),
            keys, ["name", "entity"], [F.col("name"), F.col("entity"), F.col("values")], "metrics",
        ),
        _list(queries, keys, ["measured_at", "fingerprint", "total_time"], query_fields(F.col), "_stats").select(
            *keys, F.struct(F.col("_stats").alias("stats")).alias("queries")
        ),
        _list(settings, keys, ["database", "name"], setting_fields(F.col), "settings"),
    ]


def with_children(servers: DataFrame, children: Sequence[DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """Server rows with all of their :func:`server_children`.

    The server side drives and everything matches on config name alone; children
    of an unknown server drop out.
    """
    out = servers
    for child in children:
        out = out.join(child, [*by, "config_name"], "left")
    pooler = F.when(
        F.col("pooler").isNotNull(),
        F.struct(
            omit_zero(F.col("pooler.max_server_connections")).alias("max_server_connections"),
            omit_blank(F.col("pooler.version")).alias("version"),
        ),
    )
    return out.select(
        *by, "config_name", "config_var_name", omit_blank(F.col("platform")).alias("platform"),
        "databases", "replica", "replicas", "metrics", "queries",
        omit_zero(F.col("max_connections")).alias("max_connections"), pooler.alias("pg_bouncer"),
        "settings", "version", "monitored_at",
    )


def servers_enriched(
    servers: DataFrame,
    databases: DataFrame,
    replicas_self: DataFrame,
    replica_clients: DataFrame,
    metrics: DataFrame,
    queries: DataFrame,
    settings: DataFrame,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Server rows with databases, replication, metric series, statements and settings."""
    children = server_children(databases, replicas_self, replica_clients, metrics, queries, settings, by)
    return with_children(servers, children, by)


def schema_documents(schemas: DataFrame, tables: DataFrame, indexes: DataFrame, columns: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per database with its nested schemas, tables, columns and indexes."""
    tkeys = [*by, "schema", "table_name"]
    index_lists = _list(indexes, tkeys, ["name"], index_fields(F.col), "indexes")
    column_lists = _list(columns, tkeys, ["name"], column_fields(F.col), "columns")
    table_lists = _list(
        tables.withColumnRenamed("name", "table_name").join(index_lists, tkeys, "left").join(column_lists, tkeys, "left"),
        [*by, "schema"],
        ["table_name"],
        [*table_fields(lambda n: F.col("table_name" if n == "name" else n), table_counters(tables, by)), F.col("columns"), F.col("indexes")],
        "tables",
    )
    return _list(
        schemas.withColumnRenamed("schema_name", "schema").join(table_lists, [*by, "schema"], "left"),
        by, ["schema"], [F.col("schema").alias("name"), F.col("tables")], "schemas",
    )


# ---- the document --------------------------------------------------------------------


def is_valid_report(doc: DataFrame) -> Column:
    """A report needs log metrics, servers or a test receipt."""
    return (
        (F.coalesce(F.size("log_metrics"), F.lit(0)) > 0)
        | (F.coalesce(F.size("servers"), F.lit(0)) > 0)
        | F.col("log_test_message_received_at").isNotNull()
    )


def report_document(
    servers: DataFrame,
    log_metrics: DataFrame,
    log_tests: DataFrame,
    log_stats: DataFrame,
    errors: DataFrame,
    by: Sequence[str] = BY,
    interval_seconds: int = 60,
    collector_version: str = "1.0",
) -> DataFrame:
    """One nested document per collector and interval; invalid ones are left out.

    ``servers`` comes from :func:`servers_enriched`; the others carry the ``by``
    columns.  Documents whose only content is counters or errors are not sent.
    """
    collector_col, start = by
    server_cols = [F.col(c) for c in servers.columns if c not in by]
    # The servers are nearly all of a document: joined last, they move once.
    parts = [
        log_metrics.groupBy(*by).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("received_at", "payload_id", "pos", F.map_entries("metrics").alias("kv")))),
                lambda x: F.map_from_entries(x["kv"]),
            ).alias("log_metrics")
        ),
        log_tests.select(*by, F.col("log_test_received_at").alias("log_test_message_received_at")),
        log_stats.select(
            *by,
            F.struct(
                *[omit_zero(F.col(c)).alias(c) for c in ("received", "postgres", "handled", "metric_lines", "slow_queries")]
            ).alias("_logs"),
        ),
        _list(errors, by, ["seq"], error_fields(F.col), "_errors"),
        _list(servers, by, ["config_name", "config_var_name"], server_cols, "servers"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(by), "full")
    collector = F.struct(
        F.col(collector_col).alias("uuid"),
        F.lit(collector_version).alias("version"),
        F.when(F.col("_logs").isNotNull(), F.struct(F.col("_logs").alias("logs"))).alias("stats"),
        F.col("_errors").alias("errors"),
    )
    doc = out.select(
        *by,
        "log_metrics",
        "servers",
        (F.unix_seconds(start) + interval_seconds).alias("reported_at"),
        "log_test_message_received_at",
        collector.alias("collector"),
    )
    return doc.filter(is_valid_report(doc))


def to_json_lines(documents: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The document as JSON text next to its keys; NULL fields are absent."""
    body = F.struct(*[F.col(c) for c in documents.columns if c not in by])
    return documents.select(*by, F.to_json(body).alias("value"))
