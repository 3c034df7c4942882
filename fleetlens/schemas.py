"""Declared schemas and key columns of the snapshot tables.

Every snapshot row carries the server key, the poll number of that server
(counted over all its polls, including those that returned nothing) and the poll
time.  ``ord`` is the scan order within a poll where "first" or "last" matters.
"""

from __future__ import annotations

from pyspark.sql import types as T

SERVER = ["config_name", "config_var_name", "database"]
POLL = [*SERVER, "poll_seq"]
POLL_AT = [*POLL, "measured_at"]

INTERVAL = T.StructType(
    [
        T.StructField("months", T.IntegerType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("micros", T.LongType()),
    ]
)


def _table(longs: str = "", doubles: str = "", strings: str = "", **other: T.DataType) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in SERVER]
    fields += [T.StructField("poll_seq", T.LongType()), T.StructField("measured_at", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in strings.split()]
    fields += [T.StructField(c, T.LongType()) for c in longs.split()]
    fields += [T.StructField(c, T.DoubleType()) for c in doubles.split()]
    fields += [T.StructField(c, t) for c, t in other.items()]
    return T.StructType(fields)


BLOCK_COUNTERS = (
    "shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written "
    "local_blks_hit local_blks_read local_blks_dirtied local_blks_written "
    "temp_blks_read temp_blks_written"
).split()

DB_COUNTERS = (
    "xact_commit xact_rollback blks_read blks_hit tup_returned tup_fetched tup_inserted tup_updated "
    "tup_deleted conflicts temp_files temp_bytes deadlocks blk_read_time blk_write_time"
).split()

POOLER_COUNTERS = (
    "xact_count query_count bytes_received bytes_sent xact_time query_time wait_time"
).split()

SCHEMAS: dict[str, T.StructType] = {
    "polls": _table(),
    "statements": _table(
        longs="ord query_id dbid calls rows " + " ".join(BLOCK_COUNTERS),
        doubles="total_time min_time max_time total_exec_time min_exec_time max_exec_time "
        "blk_read_time blk_write_time",
        strings="query",
    ),
    "pg_database": _table(longs="oid", strings="datname"),
    "db_stats": _table(doubles=" ".join(DB_COUNTERS)),
    "pooler_totals": _table(longs="ord", doubles=" ".join(POOLER_COUNTERS), strings="db"),
    "pooler_pools": _table(
        longs="ord cl_active cl_waiting sv_active sv_idle sv_used sv_tested sv_login maxwait maxwait_us",
        strings="db user pool_mode",
    ),
    "pooler_databases": _table(
        longs="ord port pool_size reserve_pool max_connections current paused disabled",
        strings="name host db user pool_mode",
    ),
    "pooler_versions": _table(strings="version"),
    "schemata": _table(strings="schema_name"),
    "pg_class": _table(
        longs="oid relnamespace total_bytes index_bytes toast_bytes",
        doubles="reltuples",
        strings="relname relkind",
        relpages=T.LongType(),
    ),
    "pg_namespace": _table(longs="oid", strings="nspname"),
    "columns": _table(
        longs="character_maximum_length numeric_precision numeric_scale",
        strings="table_schema table_name column_name column_default is_nullable data_type "
        "interval_type is_identity",
    ),
    "table_stat": _table(
        longs="relid seq_scan seq_tup_read idx_scan idx_tup_fetch n_tup_ins n_tup_upd n_tup_del "
        "n_live_tup n_dead_tup n_mod_since_analyze vacuum_count autovacuum_count analyze_count "
        "autoanalyze_count",
        strings="schemaname relname",
        last_vacuum=T.TimestampType(),
        last_autovacuum=T.TimestampType(),
        last_analyze=T.TimestampType(),
        last_autoanalyze=T.TimestampType(),
    ),
    "table_statio": _table(
        longs="relid heap_blks_read heap_blks_hit idx_blks_read idx_blks_hit toast_blks_read "
        "toast_blks_hit tidx_blks_read tidx_blks_hit"
    ),
    "pg_index": _table(
        longs="indexrelid indrelid",
        indisunique=T.BooleanType(),
        indisvalid=T.BooleanType(),
        indkey=T.ArrayType(T.LongType()),
    ),
    "index_stat": _table(longs="indexrelid idx_scan", strings="schemaname relname indexrelname"),
    "index_statio": _table(longs="indexrelid idx_blks_read idx_blks_hit"),
    "pg_indexes": _table(strings="schemaname indexname indexdef"),
    "pg_constraint": _table(longs="conindid"),
    "pg_stats": _table(
        doubles="null_frac", strings="schemaname tablename attname", avg_width=T.IntegerType()
    ),
    "settings": _table(
        longs="ord",
        strings="name setting unit category short_desc extra_desc context vartype source min_val "
        "max_val enumvals boot_val reset_val",
        pending_restart=T.BooleanType(),
    ),
    "activity": _table(longs="pid", strings="backend_type", backend_start=T.TimestampType()),
    "replication_clients": _table(
        longs="ord backend_xmin",
        strings="application_name client_addr client_hostname state sent_lsn write_lsn flush_lsn "
        "replay_lsn sync_state",
        client_port=T.IntegerType(),
        sync_priority=T.IntegerType(),
        backend_start=T.TimestampType(),
        write_lag=INTERVAL,
        flush_lag=INTERVAL,
        replay_lag=INTERVAL,
    ),
    "wal_receiver": _table(strings="status conninfo", lag=INTERVAL),
    "log_payloads": T.StructType(
        [
            T.StructField("payload_id", T.LongType()),
            T.StructField("received_at", T.TimestampType()),
            T.StructField("body", T.StringType()),
        ]
    ),
    "config_vars": T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
    ),
    "errors": T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("event_time", T.TimestampType()),
            T.StructField("error", T.StringType()),
            T.StructField("panic", T.BooleanType()),
            T.StructField("stack_trace", T.StringType()),
        ]
    ),
}

# Columns whose NULL makes the scan skip the row.
REQUIRED: dict[str, list[str]] = {
    "statements": ["query_id", "calls", "rows", *BLOCK_COUNTERS, "blk_read_time", "blk_write_time"],
    "db_stats": DB_COUNTERS,
    "pooler_totals": ["db", *POOLER_COUNTERS],
    "pooler_pools": [
        "db", "user", "cl_active", "cl_waiting", "sv_active", "sv_idle", "sv_used", "sv_tested",
        "sv_login", "maxwait", "maxwait_us", "pool_mode",
    ],
    "pooler_databases": [
        "port", "db", "pool_size", "reserve_pool", "max_connections", "current", "paused", "disabled",
    ],
    "schemata": ["schema_name"],
    "index_stat": ["idx_scan"],
    "index_statio": ["idx_blks_read", "idx_blks_hit"],
    "columns": ["table_schema", "table_name", "column_name", "data_type"],
    "settings": [
        "name", "setting", "category", "short_desc", "context", "vartype", "source", "pending_restart",
    ],
}
