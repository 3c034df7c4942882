"""Catalog relations: schemas, tables, columns, indexes, and how they fit together.

All joins are equi-joins that start with the server and poll keys, so a busy
server spreads over its polls and objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.rows import drop_nulls
from fleetlens.schemas import POLL, POLL_AT, REQUIRED

# --- fixed values: system schemas -----------------------------------------
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast", "heroku_ext"]
TEMP_SCHEMA_LIKES = ["pg_toast_temp_%", "pg_temp_%"]

TABLE_STATS = {
    "sequential_scans": "seq_scan",
    "sequential_scan_read_rows": "seq_tup_read",
    "index_scans": "idx_scan",
    "index_scan_read_rows": "idx_tup_fetch",
    "inserted_rows": "n_tup_ins",
    "updated_rows": "n_tup_upd",
    "deleted_rows": "n_tup_del",
    "live_row_estimate_total": "n_live_tup",
    "dead_row_estimate_total": "n_dead_tup",
    "modified_rows_since_analyze": "n_mod_since_analyze",
    "vacuum_count": "vacuum_count",
    "autovacuum_count": "autovacuum_count",
    "analyze_count": "analyze_count",
    "autoanalyze_count": "autoanalyze_count",
    "blocks_read": "heap_blks_read",
    "blocks_hit": "heap_blks_hit",
    "index_blocks_read": "idx_blks_read",
    "index_blocks_hit": "idx_blks_hit",
}
TOAST_STATS = {
    "toast_blocks_read": "toast_blks_read",
    "toast_blocks_hit": "toast_blks_hit",
    "toast_index_blocks_read": "tidx_blks_read",
    "toast_index_blocks_hit": "tidx_blks_hit",
}
TABLE_TIMES = {
    "last_vacuum_at": "last_vacuum",
    "last_autovacuum_at": "last_autovacuum",
    "last_analyze_at": "last_analyze",
    "last_autoanalyze_at": "last_autoanalyze",
}
TABLE_SIZES = ["total_bytes_total", "index_bytes_total", "toast_bytes_total", "table_bytes_total"]
COLUMN_FIELDS = [
    "name", "default", "type", "nullable", "max_length", "precision", "scale", "interval_type",
    "is_identity",
]


def is_user_schema(name: Column) -> Column:
    return ~name.isin(SYSTEM_SCHEMAS)


def schemata_user(schemata: DataFrame) -> DataFrame:
    """User schemas; the underscores of the LIKE patterns are wildcards."""
    name = F.col("schema_name")
    keep = is_user_schema(name)
    for pattern in TEMP_SCHEMA_LIKES:
        keep = keep & ~name.like(pattern)
    return schemata.filter(keep).select(*POLL_AT, "schema_name")


def table_sizes(pg_class: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    """Ordinary tables with their total, index, toast and heap bytes."""
    namespaces = pg_namespace.select(*POLL, F.col("oid").alias("relnamespace"), "nspname")

    def size(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return (
        pg_class.filter(F.col("relkind") == "r")
        .join(namespaces, [*POLL, "relnamespace"], "left")
        .filter(is_user_schema(F.col("nspname")))
        .select(
            *POLL_AT,
            F.col("nspname").alias("schema"),
            F.col("relname").alias("name"),
            size("total_bytes").alias("total_bytes_total"),
            size("index_bytes").alias("index_bytes_total"),
            size("toast_bytes").alias("toast_bytes_total"),
            (size("total_bytes") - size("index_bytes") - size("toast_bytes")).alias("table_bytes_total"),
        )
    )


def table_columns(columns: DataFrame, ordered: bool = False) -> DataFrame:
    """Columns of user tables; precision and scale only for numeric ones.

    The fleet-wide sort is optional: every consumer orders columns per table.
    """
    numeric = F.col("data_type") == "numeric"
    out = (
        drop_nulls(columns.filter(is_user_schema(F.col("table_schema"))), REQUIRED["columns"])
        .select(
            *POLL_AT,
            F.col("table_schema").alias("schema"),
            F.col("table_name").alias("table_name"),
            F.col("column_name").alias("name"),
            F.col("column_default").alias("default"),
            F.col("data_type").alias("type"),
            F.col("is_nullable").alias("nullable"),
            F.col("character_maximum_length").alias("max_length"),
            F.when(numeric, F.col("numeric_precision")).alias("precision"),
            F.when(numeric, F.col("numeric_scale")).alias("scale"),
            "interval_type",
            "is_identity",
        )
    )
    return out.orderBy(*POLL, "table_name", "name") if ordered else out


def _epoch(ts: Column) -> Column:
    """Whole seconds, rounded half away from zero."""
    return F.round(F.unix_micros(ts) / F.lit(1000000.0)).cast("bigint")


def table_stats(stat: DataFrame, statio: DataFrame) -> DataFrame:
    """Activity and IO counters per table.

    A NULL in any counter but the toast ones drops the row (tables without an
    index have NULL index counters).
    """
    io = statio.select(*POLL, "relid", *[c for c in statio.columns if c.endswith(("_read", "_hit"))])
    joined = stat.filter(is_user_schema(F.col("schemaname"))).join(io, [*POLL, "relid"])
    return drop_nulls(joined, TABLE_STATS.values()).select(
        *POLL_AT,
        F.col("schemaname").alias("schema"),
        F.col("relname").alias("name"),
        *[F.col(source).cast("bigint").alias(name) for name, source in TABLE_STATS.items()],
        *[F.coalesce(F.col(source), F.lit(0)).cast("bigint").alias(name) for name, source in TOAST_STATS.items()],
        *[_epoch(F.col(source)).alias(name) for name, source in TABLE_TIMES.items()],
    )


def index_stats(
    pg_index: DataFrame,
    pg_class: DataFrame,
    pg_namespace: DataFrame,
    index_stat: DataFrame,
    index_statio: DataFrame,
    pg_indexes: DataFrame,
) -> DataFrame:
    """Indexes of user tables with size, scans, IO and definition.

    The definition is matched by index name alone, so equal names in two schemas
    multiply.  The joins on the index id come first and share one partitioning.
    """
    classes = pg_class.join(
        pg_namespace.select(*POLL, F.col("oid").alias("relnamespace"), "nspname"), [*POLL, "relnamespace"]
    )
    index_class = classes.select(
        *POLL, F.col("oid").alias("indexrelid"), F.col("relname").alias("name"),
        F.col("nspname").alias("schema"), F.col("total_bytes").alias("bytes_total"),
    )
    table_class = classes.filter(is_user_schema(F.col("nspname"))).select(
        *POLL, F.col("oid").alias("indrelid"), F.col("relname").alias("table_name")
    )
    by_index = [*POLL, "indexrelid"]
    joined = (
        pg_index.select(*POLL_AT, "indexrelid", "indrelid", F.col("indisunique").alias("unique"),
                        F.col("indisvalid").alias("valid"))
        .join(index_stat.select(*by_index, F.col("idx_scan").alias("scans")), by_index)
        .join(
            index_statio.select(*by_index, F.col("idx_blks_read").alias("blocks_read"),
                                F.col("idx_blks_hit").alias("blocks_hit")),
            by_index,
        )
        .join(index_class, by_index)
        .join(table_class, [*POLL, "indrelid"])
        .join(
            pg_indexes.select(*POLL, F.col("indexname").alias("name"), F.col("indexdef").alias("definition")),
            [*POLL, "name"],
        )
    )
    values = ["unique", "valid", "bytes_total", "scans", "blocks_read", "blocks_hit", "definition"]
    return drop_nulls(joined, values).select(*POLL_AT, "schema", "table_name", "name", *values)


def unused_indexes(
    index_stat: DataFrame, pg_index: DataFrame, pg_constraint: DataFrame, ordered: bool = False
) -> DataFrame:
    """Never scanned indexes that are neither unique, an expression, nor a constraint."""
    by_index = [*POLL, "indexrelid"]
    candidates = pg_index.filter(
        ~F.array_contains("indkey", F.lit(0).cast("bigint")) & ~F.col("indisunique")
    ).select(*by_index)
    out = (
        index_stat.filter(F.col("idx_scan") == 0)
        .join(candidates, by_index)
        .join(pg_constraint.select(*POLL, F.col("conindid").alias("indexrelid")), by_index, "left_anti")
        .select(*POLL_AT, F.col("schemaname").alias("schema"), F.col("relname").alias("table_name"),
                F.col("indexrelname").alias("name"))
    )
    return out.orderBy(F.desc("table_name")) if ordered else out


def index_unused_flag(indexes: DataFrame, unused: DataFrame) -> DataFrame:
    """Mark the indexes whose (schema, name) is in the unused set."""
    key = [*POLL, "schema", "name"]
    marks = unused.select(*key).distinct().withColumn("_marked", F.lit(True))
    return (
        indexes.join(marks, key, "left")
        .withColumn("unused", F.col("_marked").isNotNull())
        .drop("_marked")
    )


# ---- stitching -----------------------------------------------------------------


def attach_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with the array of their columns, sorted by column name."""
    per_table = columns.groupBy(*POLL, "schema", F.col("table_name").alias("name")).agg(
        F.sort_array(F.collect_list(F.struct(*COLUMN_FIELDS))).alias("columns")
    )
    return tables.join(per_table, [*POLL, "schema", "name"], "left")


def attach_table_stats(tables: DataFrame, stats: DataFrame) -> DataFrame:
    """Tables with their counters, zeros where there are none."""
    counters = [*TABLE_STATS, *TOAST_STATS]
    key = [*POLL, "schema", "name"]
    return tables.join(stats.select(*key, *counters, *TABLE_TIMES), key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counters}
    )


def _bloat_of(bloat: DataFrame, kind: str) -> DataFrame:
    # Bloat rows arrive by descending waste, then bloat, and the last one wins.
    return (
        bloat.filter(F.col("type") == kind)
        .groupBy(*POLL, F.col("schemaname").alias("schema"), "name")
        .agg(F.min(F.struct("waste", "bloat")).alias("_b"))
        .select(*POLL, "schema", "name", F.col("_b.waste").alias("bloat_bytes_total"),
                F.col("_b.bloat").alias("bloat_factor"))
    )


def attach_bloat(objects: DataFrame, bloat: DataFrame, kind: str) -> DataFrame:
    """Tables (``kind='table'``) or indexes (``'index'``) with bloat bytes and factor."""
    return objects.join(_bloat_of(bloat, kind), [*POLL, "schema", "name"], "left").withColumns(
        {
            "bloat_bytes_total": F.coalesce("bloat_bytes_total", F.lit(0).cast("bigint")),
            "bloat_factor": F.coalesce("bloat_factor", F.lit(0.0)),
        }
    )


def in_user_schemas(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects whose schema is reported at that poll."""
    reported = schemas.select(*POLL, F.col("schema_name").alias("schema"))
    return objects.join(reported, [*POLL, "schema"], "left_semi")


def schema_tree(schemas: DataFrame, tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Schemas with nested tables, tables with nested indexes.

    The schema side drives: a table of an unlisted schema vanishes, an empty
    schema stays.  One array holds the tables of one schema of one server poll.
    """
    table_key = [*POLL, "schema", "name"]
    index_fields = [c for c in indexes.columns if c not in (*POLL_AT, "schema", "table_name")]
    table_fields = [c for c in tables.columns if c not in (*POLL_AT, "schema", "name")]
    per_table = indexes.groupBy(*POLL, "schema", F.col("table_name").alias("name")).agg(
        F.sort_array(F.collect_list(F.struct("name", *[c for c in index_fields if c != "name"]))).alias("indexes")
    )
    per_schema = (
        tables.join(per_table, table_key, "left")
        .groupBy(*POLL, "schema")
        .agg(F.sort_array(F.collect_list(F.struct("name", "indexes", *table_fields))).alias("tables"))
    )
    return schemas.withColumnRenamed("schema_name", "schema").join(per_schema, [*POLL, "schema"], "left")
