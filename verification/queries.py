"""Registered queries: each operator run over the fixtures of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import functions as L
from fleetlens.functions import text as tx
from fleetlens.operators import querystats as qs
from fleetlens.plans.top_queries import top_queries
from fleetlens.schemas import POLL, POLL_AT, SERVER
from verification.fixtures import derived_once, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            with derived_once():
                return fn(spark, sf)

        QUERIES[name] = run
        return fn

    return register


# ---- statements ------------------------------------------------------------


def _statement_inputs(spark, sf):
    return (
        fixture(spark, sf, "statements_raw"),
        fixture(spark, sf, "pg_database"),
        fixture(spark, sf, "server_versions"),
    )


def _stats(spark, sf):
    return qs.normalize_text(qs.statement_stats(*_statement_inputs(spark, sf)))


@query("statement_stats")
def _(spark, sf):
    return qs.statement_stats(*_statement_inputs(spark, sf))


@query("query_stats_delta")
def _(spark, sf):
    return qs.query_stats_delta(_stats(spark, sf))


@query("query_stats_valid")
def _(spark, sf):
    return qs.query_stats_valid(qs.query_stats_delta(_stats(spark, sf)))


def _rolled(spark, sf):
    return qs.fingerprint_rollup(qs.query_stats_valid(qs.query_stats_delta(_stats(spark, sf))))


@query("fingerprint_rollup")
def _(spark, sf):
    return _rolled(spark, sf)


@query("missing_text_placeholder")
def _(spark, sf):
    return qs.missing_text_placeholder(_rolled(spark, sf))


@query("worst_queries")
def _(spark, sf):
    return qs.worst_queries(_rolled(spark, sf).filter(~qs.is_placeholder()))


@query("top_queries")
def _(spark, sf):
    return top_queries(*_statement_inputs(spark, sf))


# ---- servers, settings, catalog --------------------------------------------

from fleetlens.operators import bloat as bl  # noqa: E402
from fleetlens.operators import catalog as cat  # noqa: E402
from fleetlens.operators import growth as gr  # noqa: E402
from fleetlens.operators import metrics as mt  # noqa: E402
from fleetlens.operators import pooler as pl  # noqa: E402
from fleetlens.operators import replication as rp  # noqa: E402
from fleetlens.operators import servers as sv  # noqa: E402


def _fix(spark, sf, *names):
    return [fixture(spark, sf, n) for n in names]


@query("server_identity")
def _(spark, sf):
    return sv.server_identity(fixture(spark, sf, "config_vars"))


@query("connections_used")
def _(spark, sf):
    return mt.connections_used(*_fix(spark, sf, "activity", "settings"))


@query("max_connections")
def _(spark, sf):
    return sv.max_connections(fixture(spark, sf, "settings"))


@query("server_version")
def _(spark, sf):
    return sv.server_version(fixture(spark, sf, "settings"))


@query("platform_flag")
def _(spark, sf):
    return sv.platform_flag(fixture(spark, sf, "schemata"))


def _pooler_metadata(spark, sf):
    return pl.pooler_metadata(*_fix(spark, sf, "pooler_versions", "pooler_pools", "pooler_databases"))


def _metadata(spark, sf):
    polls, settings, schemata = _fix(spark, sf, "polls_table", "settings", "schemata")
    return sv.server_metadata(
        polls, sv.server_version(settings), sv.max_connections(settings), sv.platform_flag(schemata),
        _pooler_metadata(spark, sf),
    )


@query("server_metadata")
def _(spark, sf):
    return _metadata(spark, sf).select(
        *POLL_AT, "version", "max_connections", "platform", "monitored_at",
        F.col("pooler.max_server_connections").alias("pooler_limit"),
        F.col("pooler.version").alias("pooler_version"),
    )


@query("schemata_user")
def _(spark, sf):
    return cat.schemata_user(fixture(spark, sf, "schemata"))


@query("table_sizes")
def _(spark, sf):
    return cat.table_sizes(*_fix(spark, sf, "pg_class", "pg_namespace"))


@query("table_columns")
def _(spark, sf):
    return cat.table_columns(fixture(spark, sf, "columns"))


@query("table_stats")
def _(spark, sf):
    return cat.table_stats(*_fix(spark, sf, "table_stat", "table_statio"))


def _indexes(spark, sf):
    return cat.index_stats(
        *_fix(spark, sf, "pg_index", "pg_class", "pg_namespace", "index_stat", "index_statio", "pg_indexes")
    )


def _unused(spark, sf):
    return cat.unused_indexes(*_fix(spark, sf, "index_stat", "pg_index", "pg_constraint"))


@query("index_stats")
def _(spark, sf):
    return _indexes(spark, sf)


@query("unused_indexes")
def _(spark, sf):
    return _unused(spark, sf)


@query("index_unused_flag")
def _(spark, sf):
    return cat.index_unused_flag(_indexes(spark, sf), _unused(spark, sf))


@query("cache_hit_rates")
def _(spark, sf):
    return mt.cache_hit_rates(*_fix(spark, sf, "index_statio", "table_statio"))


@query("settings_snapshot")
def _(spark, sf):
    return sv.settings_snapshot(fixture(spark, sf, "settings"))


# ---- replication and pooler --------------------------------------------------


def _interval_parts(df, *names):
    for name in names:
        for part in ("months", "days", "micros"):
            df = df.withColumn(f"{name}_{part}", F.col(f"{name}.{part}"))
    return df.drop(*names)


def _clients(spark, sf):
    return rp.replica_clients(fixture(spark, sf, "replication_clients"))


def _self(spark, sf):
    return rp.replica_self(*_fix(spark, sf, "wal_receiver", "activity", "known_servers"))


@query("replica_clients")
def _(spark, sf):
    return _interval_parts(_clients(spark, sf), "write_lag", "flush_lag", "replay_lag").withColumn(
        "backend_start", F.unix_seconds("backend_start")
    )


@query("replica_self")
def _(spark, sf):
    return _interval_parts(_self(spark, sf), "lag")


@query("replication_lag_metrics")
def _(spark, sf):
    return rp.replication_lag_metrics(_self(spark, sf), _clients(spark, sf))


@query("pooler_totals")
def _(spark, sf):
    return pl.pooler_totals(fixture(spark, sf, "pooler_totals"))


@query("pooler_pools")
def _(spark, sf):
    return pl.pooler_pools(fixture(spark, sf, "pooler_pools"), _pooler_metadata(spark, sf))


@query("pooler_metadata")
def _(spark, sf):
    return _pooler_metadata(spark, sf)


@query("pooler_delta")
def _(spark, sf):
    return pl.pooler_delta(pl.pooler_totals(fixture(spark, sf, "pooler_totals")), _pooler_metadata(spark, sf))


@query("database_delta")
def _(spark, sf):
    return mt.database_delta(fixture(spark, sf, "db_stats"))


# ---- bloat ---------------------------------------------------------------------


def _bloat_tables(spark, sf):
    stats, classes, spaces = _fix(spark, sf, "pg_stats", "pg_class", "pg_namespace")
    return bl.bloat_tables(bl.bloat_columns(stats), classes, spaces)


def _bloat_indexes(spark, sf):
    stats, classes, spaces, index = _fix(spark, sf, "pg_stats", "pg_class", "pg_namespace", "pg_index")
    return bl.bloat_indexes(bl.bloat_columns(stats), classes, spaces, index)


def _bloat(spark, sf):
    return bl.bloat_report(_bloat_tables(spark, sf), _bloat_indexes(spark, sf))


@query("bloat_columns")
def _(spark, sf):
    return bl.bloat_columns(fixture(spark, sf, "pg_stats"))


@query("bloat_tables")
def _(spark, sf):
    return _bloat_tables(spark, sf)


@query("bloat_indexes")
def _(spark, sf):
    return _bloat_indexes(spark, sf)


@query("bloat_report")
def _(spark, sf):
    return _bloat(spark, sf)


# ---- stitching and growth --------------------------------------------------------


def _sizes(spark, sf):
    return cat.table_sizes(*_fix(spark, sf, "pg_class", "pg_namespace"))


def _with_stats(spark, sf):
    return cat.attach_table_stats(
        _sizes(spark, sf), cat.table_stats(*_fix(spark, sf, "table_stat", "table_statio"))
    )


def _schemas(spark, sf):
    return cat.schemata_user(fixture(spark, sf, "schemata"))


def _tables(spark, sf):
    tables = cat.attach_bloat(_with_stats(spark, sf), _bloat(spark, sf), "table")
    return cat.in_user_schemas(tables, _schemas(spark, sf))


def _index_objects(spark, sf):
    flagged = cat.index_unused_flag(_indexes(spark, sf), _unused(spark, sf))
    return cat.attach_bloat(flagged, _bloat(spark, sf), "index")


@query("attach_columns")
def _(spark, sf):
    tables = cat.attach_columns(_sizes(spark, sf), cat.table_columns(fixture(spark, sf, "columns")))
    return tables.select(
        *POLL, "schema", "name", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"),
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["precision"])), ",")
        .alias("column_list"),
    ).withColumn("n_columns", F.greatest("n_columns", F.lit(0)))


@query("attach_table_stats")
def _(spark, sf):
    return _with_stats(spark, sf)


@query("attach_bloat")
def _(spark, sf):
    tables = cat.attach_bloat(_sizes(spark, sf), _bloat(spark, sf), "table")
    indexes = cat.attach_bloat(_indexes(spark, sf), _bloat(spark, sf), "index")
    keep = [*POLL, "schema", "name", "bloat_bytes_total", "bloat_factor"]
    return (
        tables.select(F.lit("table").alias("kind"), *keep)
        .unionAll(indexes.select(F.lit("index").alias("kind"), *keep))
    )


@query("schema_tree")
def _(spark, sf):
    tree = cat.schema_tree(_schemas(spark, sf), _sizes(spark, sf), _indexes(spark, sf))
    return tree.select(*POLL, "schema", F.explode_outer("tables").alias("t")).select(
        *POLL, "schema", F.col("t.name").alias("table_name"),
        F.col("t.total_bytes_total").alias("total_bytes_total"),
        F.array_join("t.indexes.name", ",").alias("index_names"),
    )


@query("table_delta")
def _(spark, sf):
    return gr.table_delta(_tables(spark, sf))


@query("index_delta")
def _(spark, sf):
    return gr.index_delta(_index_objects(spark, sf))


@query("schema_report_gate")
def _(spark, sf):
    gated = gr.schema_report_gate(_schemas(spark, sf), gr.table_delta(_tables(spark, sf)))
    return gated.select(*POLL_AT, "schema", "name", "total_bytes", "dead_row_estimate")


# ---- scalar functions over whole tables ------------------------------------------

from fleetlens.operators import fold as fd  # noqa: E402
from fleetlens.operators import logs as lg  # noqa: E402
from fleetlens.operators import report as rep  # noqa: E402
from fleetlens.plans import schema_health as sh  # noqa: E402
from fleetlens.plans.fleet_report import ReportInputs, fleet_report  # noqa: E402
from fleetlens.plans.metric_stream import metric_stream  # noqa: E402
from fleetlens.plans.slow_query_report import slow_events, slow_query_report, stream_slow_query_report  # noqa: E402
from fleetlens.sources.tables import (  # noqa: E402
    read_log_batches, read_report_json, read_snapshot, stream_log_batches, write_log_batches, write_report_json,
)
from fleetlens.sources.workspace import landed, workspace  # noqa: E402
from fleetlens.streaming.reports import report_all, reports, rows_behind, stream_reports  # noqa: E402
from fleetlens.streaming.run import drain  # noqa: E402
from fleetlens.streaming.state import stream_counter_delta, stream_explain_throttle  # noqa: E402


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("fn_round_up")
def _(spark, sf):
    value = F.col("l_extendedprice") / 7.0 * F.col("l_discount")
    return _table(spark, sf, "lineitem").select(
        *_LINE, L.round_up2(value).alias("up2"), L.round_up4(value).alias("up4")
    )


@query("fn_ratio4")
def _(spark, sf):
    return _table(spark, sf, "lineitem").select(
        *_LINE, L.ratio4(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")
    )


@query("fn_hit_ratio")
def _(spark, sf):
    return _table(spark, sf, "lineitem").select(
        *_LINE, L.hit_ratio(F.col("l_partkey") % 50, F.col("l_suppkey") % 10).alias("ratio")
    )


@query("fn_version_cmp")
def _(spark, sf):
    a, b = F.col("left_version"), F.col("right_version")
    return fixture(spark, sf, "versions").select(
        *_LINE, L.version_compare(a, b).alias("cmp"), L.version_gt(a, b).alias("gt"), L.version_gte(a, b).alias("gte")
    )


def _corpus(spark, sf):
    return fixture(spark, sf, "corpus")


def _text_query(name, build):
    @query(name)
    def _(spark, sf):
        return _corpus(spark, sf).select("row_key", *build(F.col("text")))


_text_query("fn_clean_query", lambda t: [tx.clean_query(t).alias("cleaned")])
_text_query(
    "fn_parse_comment",
    lambda t: [tx.query_comment(t).alias("comment"), tx.strip_comments(t).alias("query")],
)
_text_query("fn_redact_ip", lambda t: [tx.redact_ip(t).alias("redacted")])
_text_query("fn_obfuscate_query", lambda t: [tx.obfuscate_query(t).alias("obfuscated")])
_text_query("fn_truncate_query", lambda t: [tx.truncate_query(t).alias("truncated")])


@query("fn_is_collector_query")
def _(spark, sf):
    return _corpus(spark, sf).filter(~tx.is_collector_comment(tx.query_comment(F.col("text")))).select("row_key")


@query("fn_fingerprint")
def _(spark, sf):
    normal = tx.clean_query(tx.obfuscate_query(tx.strip_comments(F.col("text"))))
    return (
        _corpus(spark, sf)
        .select(tx.fingerprint(normal).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("fn_missing_text")
def _(spark, sf):
    stats = fixture(spark, sf, "statements_raw")
    return qs.normalize_text(stats).select(*POLL, "ord", "query", "fingerprint")


@query("fn_obfuscate_explain")
def _(spark, sf):
    return fixture(spark, sf, "explain_events").select(
        "event_id", L.obfuscate_explain(F.col("plan")).alias("plan")
    )


@query("fn_conninfo")
def _(spark, sf):
    info = F.col("conninfo")
    return fixture(spark, sf, "conninfos").select(
        "c_custkey",
        L.conninfo_value(info, "host").alias("host"),
        L.conninfo_value(info, "application_name").alias("application_name"),
    )


@query("fn_lsn_diff")
def _(spark, sf):
    return fixture(spark, sf, "replication_clients").select(
        *POLL, "ord", L.lsn_diff(F.col("sent_lsn"), F.col("replay_lsn")).alias("bytes")
    )


@query("fn_interval_ms")
def _(spark, sf):
    return fixture(spark, sf, "replication_clients").select(
        *POLL, "ord", L.interval_ms(F.col("write_lag")).alias("write_ms"),
        L.interval_ms(F.col("replay_lag")).alias("replay_ms"),
    )


def _payloads(spark, sf):
    return fixture(spark, sf, "log_payloads")


def _lines(spark, sf):
    return _payloads(spark, sf).select(
        "payload_id", "received_at", F.posexplode(F.split("body", "\n")).alias("pos", "line")
    )


@query("fn_syslog_line")
def _(spark, sf):
    parsed = _lines(spark, sf).select("payload_id", "pos", L.syslog_line(F.col("line")).alias("s"))
    return parsed.filter(F.col("s").isNotNull()).select("payload_id", "pos", "s.*")


@query("fn_log_timestamp")
def _(spark, sf):
    parsed = _lines(spark, sf).select(
        "payload_id", "pos", "received_at", L.syslog_line(F.col("line")).alias("s")
    ).filter(F.col("s").isNotNull())
    return parsed.select(
        "payload_id", "pos", L.log_timestamp(F.col("s.timestamp"), F.unix_seconds("received_at")).alias("at")
    )


@query("fn_slow_query_line")
def _(spark, sf):
    parsed = _lines(spark, sf).select("payload_id", "pos", L.slow_query_line(F.col("line")).alias("q"))
    return parsed.filter(F.col("q").isNotNull()).select("payload_id", "pos", "q.*")


@query("fn_key_values")
def _(spark, sf):
    maps = _lines(spark, sf).select(
        "payload_id", "pos", F.explode(L.key_values(F.col("line"), F.unix_seconds("received_at"))).alias("key", "value")
    )
    return maps


@query("fn_omit_empty")
def _(spark, sf):
    cols = cat.table_columns(fixture(spark, sf, "columns"))
    return cols.select(*POLL, "table_name", *rep.column_fields(F.col))


def _own(name):
    """A column under a name that no report field has."""
    return F.col(name).alias(f"of_{name}")


@query("report_settings")
def _(spark, sf):
    return sv.settings_snapshot(fixture(spark, sf, "settings")).select(*[_own(c) for c in POLL], *rep.setting_fields(F.col))


@query("report_replicas")
def _(spark, sf):
    return _clients(spark, sf).select(*[_own(c) for c in [*POLL, "ord"]], *rep.replica_client_fields(F.col))


@query("report_statements")
def _(spark, sf):
    """Polled statements and slow queries with plans, as a report shows them."""
    polled = qs.query_stats_valid(qs.query_stats_delta(_stats(spark, sf)))
    return mt.append_rows(polled, _slow_events(spark, sf)).select(_own("config_name"), *rep.query_fields(F.col))


@query("report_tables")
def _(spark, sf):
    tables = gr.table_delta(_tables(spark, sf))
    return tables.select(*[_own(c) for c in [*POLL, "schema"]], *rep.table_fields(F.col, rep.table_counters(tables)))


@query("report_indexes")
def _(spark, sf):
    return gr.index_delta(_index_objects(spark, sf)).select(*[_own(c) for c in [*POLL, "schema", "table_name"]], *rep.index_fields(F.col))


@query("report_errors")
def _(spark, sf):
    return fd.error_cap(fixture(spark, sf, "errors"), "1 day").select("seq", *rep.error_fields(F.col))


# ---- logs ------------------------------------------------------------------------


def _stitched(spark, sf):
    return lg.log_stitch(lg.log_prefilter(_payloads(spark, sf)))


def _landed_payloads(spark, sf):
    """A folder of gzip JSON lines, one payload each, as a log receiver leaves them."""
    path = workspace(spark, "payloads") + "/landing"
    write_log_batches(_payloads(spark, sf), path)
    return path


@query("src_log_payloads")
def _(spark, sf):
    """Payload files as landed, by the order of their receipt."""
    return read_log_batches(spark, _landed_payloads(spark, sf)).select(
        "payload_id", F.unix_seconds("received_at").alias("received_at"),
        F.size(F.split("body", "\n")).alias("n_lines"), F.octet_length("body").cast("bigint").alias("n_bytes"),
    )


@query("log_prefilter")
def _(spark, sf):
    return lg.log_prefilter(_payloads(spark, sf)).select("payload_id")


@query("log_test_marker")
def _(spark, sf):
    windowed = fd.report_window(_payloads(spark, sf), "received_at", "1 day")
    return lg.log_test_marker(windowed, by=["report_start"]).withColumn(
        "report_start", F.unix_seconds("report_start")
    )


@query("log_stitch")
def _(spark, sf):
    return _stitched(spark, sf).drop("received_at")


@query("log_route")
def _(spark, sf):
    return lg.log_route(_stitched(spark, sf)).select("payload_id", "pos", "branch")


@query("log_metrics")
def _(spark, sf):
    return lg.log_metrics(_stitched(spark, sf)).select("payload_id", "pos", F.explode("metrics").alias("key", "value"))


@query("slow_query_events")
def _(spark, sf):
    return lg.slow_query_events(lg.slow_query_lines(_stitched(spark, sf)), fixture(spark, sf, "servers")).drop("received_at")


def _slow_summary(events):
    return events.groupBy("config_name", "fingerprint", "query").agg(
        F.sum("calls").alias("calls"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
        F.max("measured_at").alias("measured_at"), F.count("explain").alias("n_plans"),
        F.min("explain").alias("first_plan"), F.max("explain").alias("last_plan"),
    )


def _slow_events(spark, sf):
    return slow_query_report(_payloads(spark, sf), fixture(spark, sf, "servers"), fixture(spark, sf, "plan_events"))


@query("slow_query_report")
def _(spark, sf):
    """Slow statements per server and fingerprint, with the plans taken of them."""
    return _slow_summary(_slow_events(spark, sf))


@query("slow_query_plans")
def _(spark, sf):
    """The slow queries that carry a plan."""
    return _slow_events(spark, sf).filter("explain is not null").select(
        *SERVER, "fingerprint", "payload_id", "pos", "measured_at", "explain"
    )


@query("explain_throttle")
def _(spark, sf):
    return lg.explain_throttle(fixture(spark, sf, "explain_events"), ["config_name", "fingerprint"]).select(
        "event_id", "config_name", "fingerprint", "measured_at", "plan"
    )


@query("collector_log_stats")
def _(spark, sf):
    return fd.collector_log_stats(_payloads(spark, sf), "1 hour").withColumn(
        "report_start", F.unix_seconds("report_start")
    )


# ---- metrics and folding ------------------------------------------------------------


@query("metric_series")
def _(spark, sf):
    samples = fixture(spark, sf, "metrics_long").withColumn("at", F.timestamp_seconds("measured_at"))
    series = mt.metric_series(fd.report_window(samples, "at"), order=["ord"], by=["report_start"])
    return series.select(
        F.unix_seconds("report_start").alias("report_start"), "config_name", "name", "entity",
        F.posexplode("values").alias("pos", "v"),
    ).select("report_start", "config_name", "name", "entity", "pos", "v.value", "v.measured_at")


def _metric_stream(spark, sf):
    return metric_stream(
        *_fix(spark, sf, "activity", "settings", "db_stats", "index_statio", "table_statio", "pooler_totals", "pooler_pools"),
        _pooler_metadata(spark, sf), _self(spark, sf), _clients(spark, sf),
    )


@query("metric_stream")
def _(spark, sf):
    return _metric_stream(spark, sf)


@query("append_stats")
def _(spark, sf):
    keep = [*SERVER, "fingerprint", "query", "calls", "total_time", "measured_at"]
    polled = qs.query_stats_valid(qs.query_stats_delta(_stats(spark, sf))).select(*keep)
    slow = slow_events(_payloads(spark, sf), fixture(spark, sf, "servers")).select(*keep)
    return mt.append_rows(polled, slow)


@query("error_cap")
def _(spark, sf):
    return fd.error_cap(fixture(spark, sf, "errors"), "1 day").withColumns(
        {"report_start": F.unix_seconds("report_start"), "event_time": F.unix_seconds("event_time")}
    )


@query("fold_servers")
def _(spark, sf):
    folded = fd.fold_servers(fixture(spark, sf, "server_records"))
    return folded.select(
        "config_name", "config_var_name", "monitored_at", "version", "max_connections", "platform",
        F.col("pooler.version").alias("pooler_version"), F.col("pooler.max_server_connections").alias("pooler_limit"),
    )


@query("latest_database")
def _(spark, sf):
    return fd.latest_poll(_sizes(spark, sf))


@query("latest_replication")
def _(spark, sf):
    return fd.latest(_self(spark, sf), SERVER, "poll_seq").drop("lag")


@query("latest_settings")
def _(spark, sf):
    return fd.latest_settings(sv.settings_snapshot(fixture(spark, sf, "settings")))


@query("report_window")
def _(spark, sf):
    timed = _table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        fd.report_window(timed, "ts")
        .groupBy("report_start", "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("report_start", F.unix_seconds("report_start"))
    )


# ---- compositions -------------------------------------------------------------------


def _catalog(spark, sf):
    names = list(sh.CatalogSnapshots.__dataclass_fields__)
    return sh.CatalogSnapshots(**{n: fixture(spark, sf, n) for n in names})


@query("schema_health")
def _(spark, sf):
    c = _catalog(spark, sf)
    common = [*POLL_AT, "schema", "name", "bloat_bytes", "bloat_bytes_total", "bloat_factor", "blocks_read", "blocks_hit"]
    tables = sh.table_health(c).select(
        F.lit("table").alias("kind"), *common, F.col("total_bytes").alias("bytes"), F.col("total_bytes_total").alias("bytes_total")
    )
    indexes = sh.index_health(c).select(F.lit("index").alias("kind"), *common, "bytes", "bytes_total")
    return tables.unionByName(indexes)


def _collector_of(config_name):
    return F.concat(F.lit("collector_"), F.element_at(F.split(config_name, "_"), -1))


def _aligned(rows, time, group, per_collector):
    """Logs and errors carry calendar times; their day of month is the poll they belong to."""
    collector = F.floor(F.col(group) / per_collector).cast("string")
    return rows.withColumns(
        {"collector_id": F.concat(F.lit("collector_"), collector),
         time: F.timestamp_seconds(1700000000 + 60 * F.day(time).cast("bigint"))}
    )


def _report_payloads(spark, sf):
    return _aligned(_payloads(spark, sf), "received_at", "payload_id", 2500)


def _report_errors(spark, sf):
    return _aligned(fixture(spark, sf, "errors"), "event_time", "seq", 10000)


def _report_inputs(spark, sf):
    c = _catalog(spark, sf)
    payloads, errors = _report_payloads(spark, sf), _report_errors(spark, sf)
    # Plans are taken of the lines as logged; the report shows them in the minutes of the aligned payloads.
    slow = _slow_events(spark, sf).drop("received_at").join(payloads.select("payload_id", "received_at"), "payload_id").withColumn(
        "measured_at", F.unix_seconds("received_at")
    )
    metadata = _metadata(spark, sf).withColumn("ord", F.col("poll_seq"))
    return ReportInputs(
        server_records=metadata.drop("database"),
        schemas=cat.schemata_user(c.schemata).filter(F.col("poll_seq") > 1),
        tables=sh.table_health(c),
        indexes=sh.index_health(c),
        columns=cat.table_columns(fixture(spark, sf, "columns")),
        replica=_self(spark, sf),
        replica_clients=_clients(spark, sf),
        metrics=_metric_stream(spark, sf),
        worst_queries=top_queries(*_statement_inputs(spark, sf), step=landed),
        slow_queries=slow,
        settings=sv.settings_snapshot(fixture(spark, sf, "settings")),
        payloads=payloads,
        errors=errors,
        collector_of=_collector_of,
    )


def _documents(spark, sf):
    return fleet_report(_report_inputs(spark, sf))


@query("fleet_report")
def _(spark, sf):
    return rep.to_json_lines(_documents(spark, sf)).select("collector_id", "report_start", F.col("value").alias("document"))


def _log_documents(payloads, errors, records):
    """Documents of log content and servers: metric lines, counters, test receipts and errors."""
    by = list(rep.BY)
    windowed = fd.report_window(payloads, "received_at")
    lines = lg.log_metrics(lg.log_stitch(lg.log_prefilter(windowed)))
    placed = fd.report_window(records.withColumn("at", F.timestamp_seconds("measured_at")), "at")
    folded = fd.fold_servers(placed.withColumn("collector_id", _collector_of(F.col("config_name"))), by=by)
    return rep.report_document(
        folded, lines, lg.log_test_marker(windowed, by=by), fd.collector_log_stats(payloads, by=["collector_id"]),
        fd.error_cap(errors, by=["collector_id"]), by,
    )


def _small_documents(spark, sf):
    return _log_documents(_report_payloads(spark, sf), _report_errors(spark, sf), fixture(spark, sf, "server_records"))


def _flat_documents(documents):
    """One flat row per document; metric lines as text in the order of the document."""
    pairs = F.transform(F.col("log_metrics"), lambda m: F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    ))
    return documents.select(
        F.col("collector.uuid").alias("collector_id"), (F.col("reported_at") - 60).alias("report_start"), "reported_at",
        F.coalesce(F.size("log_metrics"), F.lit(0)).alias("n_log_metrics"),
        F.coalesce(F.size("servers"), F.lit(0)).alias("n_servers"),
        F.coalesce(F.size("collector.errors"), F.lit(0)).alias("n_errors"),
        "log_test_message_received_at",
        F.col("collector.stats.logs.received").alias("received"),
        F.col("collector.stats.logs.handled").alias("handled"),
        F.array_join("servers.config_name", ",").alias("config_names"),
        F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("log_lines"),
        F.coalesce(F.array_join("collector.errors.error", ";"), F.lit("")).alias("error_texts"),
    )


@query("report_document")
def _(spark, sf):
    return _flat_documents(_small_documents(spark, sf))


@query("servers_enriched")
def _(spark, sf):
    by = ["poll_seq"]
    metadata = _metadata(spark, sf).withColumn("ord", F.col("poll_seq")).drop("database")
    servers = fd.fold_servers(metadata, by=by)
    databases = (
        _schemas(spark, sf).filter(F.col("poll_seq") > 1).groupBy(*by, "config_name", "database")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("schema_name").alias("name")))).alias("schemas"))
    )
    slow = _slow_events(spark, sf).withColumn("poll_seq", F.pmod("payload_id", F.lit(5)) + 1)
    queries = mt.append_rows(top_queries(*_statement_inputs(spark, sf)), slow)
    out = rep.servers_enriched(
        servers, databases, _self(spark, sf), _clients(spark, sf),
        mt.connections_used(*_fix(spark, sf, "activity", "settings")), queries,
        sv.settings_snapshot(fixture(spark, sf, "settings")), by,
    )
    return out.select(
        "poll_seq", "config_name", "config_var_name", "platform", "max_connections", "version", "monitored_at",
        F.coalesce(F.size("databases"), F.lit(0)).alias("n_databases"),
        F.array_join(F.flatten(F.transform("databases", lambda d: d["schemas"]["name"])), ",").alias("schema_names"),
        F.col("replica.application_name").alias("replica_name"),
        F.coalesce(F.size("replicas"), F.lit(0)).alias("n_replicas"),
        F.coalesce(F.size("metrics"), F.lit(0)).alias("n_metrics"),
        F.coalesce(F.size("queries.stats"), F.lit(0)).alias("n_queries"),
        F.aggregate(F.coalesce("queries.stats.time", F.array().cast("array<double>")), F.lit(0.0),
                    lambda a, x: F.greatest(a, F.coalesce(x, F.lit(0.0)))).alias("max_time"),
        F.coalesce(F.size("settings"), F.lit(0)).alias("n_settings"),
        F.array_join(F.array_sort(F.coalesce("queries.stats.explain", F.array().cast("array<string>"))), ";").alias("explains"),
    )


@query("sink_report_json")
def _(spark, sf):
    """Write gzip JSON lines to the shared folder, read them back with their schema and flatten them."""
    path = workspace(spark, "reports") + "/reports"
    documents = _small_documents(spark, sf)
    write_report_json(documents, path)
    return _flat_documents(read_report_json(spark, path, documents.drop(*rep.BY).schema))


@query("fleet_report_content")
def _(spark, sf):
    """Settings, replicas and statements of the whole fleet's documents, written as JSON and read back."""
    path = workspace(spark, "reports") + "/reports"
    documents = _documents(spark, sf)
    write_report_json(documents, path)
    servers = read_report_json(spark, path, documents.drop(*rep.BY).schema).select(
        F.col("collector.uuid").alias("collector_id"), (F.col("reported_at") - 60).alias("report_start"), F.explode("servers").alias("s")
    )

    def part(kind, items, name, value):
        rows = servers.select("collector_id", "report_start", F.col("s.config_name").alias("config_name"), F.explode(items).alias("x"))
        return rows.select("collector_id", "report_start", "config_name", F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"))

    x = F.col("x")
    return (
        part("setting", "s.settings", x["name"], F.concat_ws("|", x["value"], x["unit"], x["source"], x["boot_val"]))
        .unionByName(part("replica", "s.replicas", x["application_name"], F.concat_ws("|", x["state"], x["sync_state"], x["sync_priority"])))
        .unionByName(part("statement", "s.queries.stats", x["fingerprint"], F.concat_ws("|", x["calls"], x["rows"], x["explain"])))
    )


@query("src_snapshots")
def _(spark, sf):
    """Land a snapshot table in the shared folder and scan it with its declared schema."""
    path = workspace(spark, "snapshots") + "/index_statio"
    fixture(spark, sf, "index_statio").write.parquet(path)
    return read_snapshot(spark, "index_statio", path)


# ---- streams ---------------------------------------------------------------------------


@query("stream_logs")
def _(spark, sf):
    stream = stream_log_batches(spark, _landed_payloads(spark, sf))
    routed = lg.log_route(lg.log_stitch(lg.log_prefilter(stream))).select("payload_id", "pos", "branch")
    return drain(spark, routed, "logs")


#: Rows that one file of a micro-batch holds at least, where there are more files than one.
FILE_ROWS = 250_000


def _out_of_order(rows, *key, n=4):
    """Rows with the ``_file`` they arrive in: by time, but up to a quarter of a file late; and that delay.

    The rows are written down first: deriving them is the larger part of the work, and they are read several times.
    """
    rows = landed(rows, "arriving")
    lo, hi = rows.agg(F.min("measured_at"), F.max("measured_at")).first()
    step = ((hi or 0) - (lo or 0)) // n + 1
    late = F.pmod(F.xxhash64(*key), F.lit(step // 4 + 1))
    place = F.floor((F.col("measured_at") + late - (lo or 0)) / step)
    return rows.withColumn("_file", F.least(place, F.lit(n - 1)).cast("int")), f"{step // 4 + 1} seconds", (hi or 0) + 10 * step


def _in_files(spark, rows, purpose, last=None, n=4):
    """A stream of ``n`` parts, one a micro-batch; then ``last``, later rows that push the watermark on.

    A part is one file while it is small, else several that are written and read side by side.  All parts
    have the same number of them, and a part is written once the one before is, so a micro-batch takes
    the files of one part.
    """
    path, schema = workspace(spark, purpose), rows.drop("_file").schema
    sizes = {r["_file"]: r["count"] for r in rows.groupBy("_file").count().collect()}
    files = max(1, min(sizes.get(k, 0) for k in range(n)) // FILE_ROWS)
    parts = [rows.filter(F.col("_file") == k).drop("_file") for k in range(n)] + ([] if last is None else [last])
    for k, part in enumerate(parts):
        part = part.repartition(files) if files > 1 and k < n else part.coalesce(1)
        part.write.mode("append").parquet(f"{path}/landing")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landing")


def _one_row(spark, like, **values):
    return spark.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name != "_file"]
    )


@query("stream_counter_delta")
def _(spark, sf):
    """Polls in files out of order, in several micro-batches; ``behind`` marks what came too late."""
    counters = ["calls", "total_time", "rows"]
    stats = qs.statement_stats(*_statement_inputs(spark, sf)).select(
        *SERVER, "query_id", "poll_seq", "measured_at", "ord", *counters
    )
    rows, delay, later = _out_of_order(stats, *SERVER, "query_id", "poll_seq")
    end = _one_row(spark, stats, poll_seq=1, ord=1, measured_at=later)
    stream = _in_files(spark, rows, "polls", end)
    return drain(spark, stream_counter_delta(stream, [*SERVER, "query_id"], counters, delay), "deltas")


@query("stream_explain_throttle")
def _(spark, sf):
    events, delay, later = _out_of_order(fixture(spark, sf, "explain_events"), "event_id")
    end = _one_row(spark, events, event_id=0, raw="x", measured_at=later)
    stream = _in_files(spark, events, "plans", end)
    throttled = drain(spark, stream_explain_throttle(stream, delay, ["config_name", "fingerprint"]), "throttle")
    return throttled.filter("config_name is not null").select("event_id", "config_name", "fingerprint", "measured_at", "plan", "behind")


@query("stream_slow_query_report")
def _(spark, sf):
    """Payloads and plans in files out of order; the same summary as in batch."""
    servers = fixture(spark, sf, "servers")
    plans, delay, later = _out_of_order(fixture(spark, sf, "plan_events"), "plan_id")
    known = servers.agg(F.min("config_name").alias("config_name"))
    end = known.crossJoin(_one_row(spark, plans, plan_id=0, raw="select 1", measured_at=later).drop("config_name")).select(*plans.drop("_file").columns)
    payloads, other_delay, _ = _out_of_order(_payloads(spark, sf).withColumn("measured_at", F.unix_seconds("received_at")), "payload_id")
    longest = max(delay, other_delay, key=lambda d: int(d.split()[0]))
    # The fallback of an unreadable time is the receipt of a payload of several lines.
    report = stream_slow_query_report(
        _in_files(spark, payloads, "payloads").drop("measured_at"), servers, _in_files(spark, plans, "plans", end), longest
    )
    events = drain(spark, report, "slow")
    return _slow_summary(events.filter("not behind"))


@query("stream_fleet_report")
def _(spark, sf):
    """Payloads, errors and server records in files out of order; the same documents as in batch."""
    kinds = {
        "payloads": (_report_payloads(spark, sf).withColumn("measured_at", F.unix_seconds("received_at")), "payload_id"),
        "errors": (_report_errors(spark, sf).withColumn("measured_at", F.unix_seconds("event_time")), "seq"),
        "records": (fixture(spark, sf, "server_records"), "ord"),
    }
    streams, delays = {}, []
    for kind, (rows, key) in kinds.items():
        filed, delay, later = _out_of_order(rows, key)
        end = _one_row(spark, filed, measured_at=2 * later)
        stream = _in_files(spark, filed, kind, end)
        streams[kind] = (stream.withColumn("at", F.timestamp_seconds("measured_at")), "at")
        delays.append(int(delay.split()[0]))

    def build(parts):
        return _log_documents(*[parts[k].drop("at") for k in ("payloads", "errors", "records")])

    base = workspace(spark, "stream-reports")
    report_all(spark, stream_reports(streams, build, base, max(delays)))
    return _flat_documents(reports(spark, base))


@query("stream_report_window")
def _(spark, sf):
    """Events per minute over four files, where every fiftieth event comes in the last; ``n_behind`` counts what was late."""
    events = _table(spark, sf, "events").select(
        "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("measured_at")
    )
    lo, hi = events.agg(F.min("measured_at"), F.max("measured_at")).first()
    step = ((hi or 0) - (lo or 0)) // 4 + 1
    place = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.floor((F.col("measured_at") - (lo or 0)) / step))
    filed = events.withColumn("_file", place.cast("int"))
    stream = _in_files(spark, filed, "events", _one_row(spark, filed, measured_at=(hi or 0) + 10 * step))
    timed = stream.withColumn("at", F.timestamp_seconds("measured_at"))
    minute = (F.floor(F.col("measured_at") / 60) * 60).cast("bigint").alias("report_start")

    def counted(rows, name):
        return rows.groupBy(minute, "event_type").agg(F.count(F.lit(1)).alias(name))

    base = workspace(spark, "stream-window")
    report_all(spark, stream_reports({"events": (timed, "at")}, lambda parts: counted(parts["events"], "n"), base, 600))
    late = counted(rows_behind(spark, base, "events"), "n_behind")
    both = reports(spark, base).join(late, ["report_start", "event_type"], "full")
    return both.select("report_start", "event_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_behind")])
