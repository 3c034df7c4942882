"""The same results as plain SQL for the checking engine."""

from __future__ import annotations

from verification.fixtures import Dialect, ctes

D = Dialect()
ORACLES: dict[str, str] = {}


def oracle(name: str, fixtures: str, body: str, *shared: str) -> None:
    """Register ``WITH <fixtures>, <shared CTEs> <body>``; body may start with its own CTEs."""
    parts = [ctes(D, *fixtures.split())] if fixtures else []
    parts += list(shared)
    ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


K = "config_name, config_var_name, database, poll_seq"
KA = K + ", measured_at"
S = "config_name, config_var_name, database"


def up(expr: str, places: int) -> str:
    scale = f"1{'0' * places}.0e0"
    return f"(ceil(({expr}) * {scale}) / {scale})"


def ratio4(n: str, d: str) -> str:
    n, d = f"cast({n} as double)", f"cast({d} as double)"
    return f"(case when {d} = 0 then 0.0e0 else {up(f'{n} / {d}', 4)} end)"


def hit(h: str, r: str) -> str:
    return ratio4(h, f"(cast({h} as double) + cast({r} as double))")


# ---- text (RE2 patterns) ------------------------------------------------------

WS = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COMMENT = r"(?:/\*)+?[\w\W]+?(?:\*/)+"
PARAM = r"(?:\s*'[^']+'|\d+\.?\d*|\$\d+)"
VALUE = r"(?:'[^']+'|\d+\.?\d*|\$\d+)"
OPERATOR = r"(?i)((?:=|>|<|i?like|limit|select|offset|then)\s*)" + PARAM
TUPLE = r"\((?:'?.+?'|'?.+?'?)\)"
LIST = r"(?i)(\b(?:in|values)\s*)" + TUPLE + r"(?:,\s*" + TUPLE + r")*"
BETWEEN = r"(?i)(\bbetween(?:\s*symmetric)?\s*)" + VALUE + r"(\s*AND\s*)" + VALUE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'), ' ')"


def redact(x: str) -> str:
    return f"regexp_replace({x}, {q(r'(?:[0-9]{1,3}\.){3}[0-9]{1,3}')}, 'REDACTED', 'g')"


def truncate(x: str, limit: int) -> str:
    # longest prefix of whole characters within the byte limit
    fit = (
        f"list_max(list_filter(range({limit // 4}, {limit + 1}), "
        f"lambda k: octet_length(encode(left({x}, k))) <= {limit}))"
    )
    return f"(case when octet_length(encode({x})) > {limit} then left({x}, {fit}) || 'TRUNCATED' else {x} end)"


def comment(x: str) -> str:
    joined = f"coalesce(array_to_string(regexp_extract_all({x}, {q(COMMENT)}), ''), '')"
    return truncate(joined, 1000)


def strip(x: str) -> str:
    return (
        f"(case when regexp_matches({x}, {q(COMMENT)}) "
        f"then {trim_ws(f'regexp_replace({x}, {q(COMMENT)}, {q(str())}, {q(chr(103))})')} else {x} end)"
    )


def obfuscate(x: str) -> str:
    x = f"regexp_replace({x}, {q(OPERATOR)}, '\\1?', 'g')"
    x = f"regexp_replace({x}, {q(LIST)}, '\\1(?)', 'g')"
    return f"regexp_replace({x}, {q(BETWEEN)}, '\\1?\\2?', 'g')"


COLLECTOR = "/* app:fleet-collector */"

# ---- statements -----------------------------------------------------------------

COUNTERS = (
    "calls total_time rows shared_blks_hit shared_blks_read shared_blks_dirtied shared_blks_written "
    "local_blks_hit local_blks_read local_blks_dirtied local_blks_written temp_blks_read "
    "temp_blks_written blk_read_time blk_write_time"
).split()


def cols(names, fmt="{}", sep=", "):
    return sep.join(fmt.format(*([n] * fmt.count("{}"))) for n in names)


SCAN = f"""stmt AS (
  select {cols(['s.' + c for c in KA.split(', ')])}, s.ord, s.query_id, s.query,
         s.calls, case when modern then total_exec_time else total_time end as total_time,
         case when modern then min_exec_time else min_time end as min_time,
         case when modern then max_exec_time else max_time end as max_time,
         {cols(['s.' + c for c in COUNTERS if c not in ('calls', 'total_time')])}
  from statements_raw s
  join pg_database b on {cols(K.split(', '), 's.{} = b.{}', ' and ')} and s.dbid = b.oid and b.datname = s.database
  left join (select *, cast(split_part(version, '.', 1) as int) >= 13 as modern from server_versions) v
    on {cols(S.split(', '), 's.{} = v.{}', ' and ')}
)"""

TEXT = f"""cleaned AS (
  select *, {clean(obfuscate(strip('redacted')))} as cleaned, coalesce({comment('redacted')}, '') as comment
  from (select *, {redact('query')} as redacted from stmt) r
), norm AS (
  select {KA}, ord, query_id, coalesce({truncate('cleaned', 5000)}, 'MISSING') as query, comment,
         case when cleaned is null then '' else substr(md5(cleaned), 1, 10) end as fingerprint,
         min_time, max_time, {cols(COUNTERS)}
  from cleaned where not contains(comment, '{COLLECTOR}')
)"""

DELTA = f"""first_now AS (
  select * from norm qualify row_number() over (partition by {K}, query_id order by ord) = 1
), delta AS (
  select *, {ratio4('total_time', 'calls')} as mean_time, blk_read_time + blk_write_time as total_blk_io_time
  from (
    select {cols(KA.split(', '), 'n.{}')}, p.ord, n.query_id, n.query, n.comment, n.fingerprint, n.min_time, n.max_time,
           {cols(COUNTERS, 'n.{} - p.{} as {}')}
    from norm p join first_now n
      on {cols(S.split(', '), 'p.{} = n.{}', ' and ')} and p.query_id = n.query_id and n.poll_seq = p.poll_seq + 1
  ) d
)"""

VALID = """valid AS (
  select * from delta where total_time > 0 and calls > 0 and rows >= 0 and shared_blks_hit >= 0 and shared_blks_read >= 0
    and shared_blks_dirtied >= 0 and shared_blks_written >= 0 and blk_read_time >= 0 and blk_write_time >= 0
    and total_blk_io_time >= 0
)"""

LONGS = [c for c in COUNTERS if not c.endswith("_time")]
ROLLED = f"""rolled AS (
  select {K}, max(measured_at) as measured_at, min(ord) as ord,
         arg_min(query_id, ord) as query_id, arg_min(query, ord) as query, arg_min(comment, ord) as comment, fingerprint,
         {cols(LONGS, 'cast(sum({}) as bigint) as {}')},
         sum(total_time) as total_time, sum(blk_read_time) as blk_read_time, sum(blk_write_time) as blk_write_time,
         min(min_time) as min_time, max(max_time) as max_time,
         case when count(*) = 1 then max(mean_time) else {ratio4('sum(total_time)', 'sum(calls)')} end as mean_time,
         case when count(*) = 1 then max(total_blk_io_time) else sum(blk_read_time) + sum(blk_write_time) end as total_blk_io_time
  from valid group by {K}, fingerprint
)"""

STATS_ORDER = [*KA.split(", "), "ord", "query_id", "query", "comment", "fingerprint", *COUNTERS,
               "min_time", "max_time", "mean_time", "total_blk_io_time"]

_zero = [c for c in STATS_ORDER if c not in (*K.split(", "), "query", "comment", "fingerprint")]
_zero_sql = cols(_zero, "case when query = 'MISSING' and fingerprint = '' then 0 else {} end as {}")
PLACED = f"""placed AS (
  select {K}, query, fingerprint, case when query = 'MISSING' and fingerprint = '' then '' else comment end as comment, {_zero_sql}
  from rolled
)"""


def worst(source: str) -> str:
    """Greedy passes with anti joins, unlike the chained windows of the query."""
    chain = [f"c0 AS (select * from {source} where calls > 0 and not (query = 'MISSING' and fingerprint = ''))"]
    taken = []
    for i, (name, measure, cond) in enumerate(
        [("calls", "calls", "true"), ("total_time", "total_time", "true"),
         ("mean_time", "mean_time", "mean_time >= 10"), ("block_io", "total_blk_io_time", "total_blk_io_time >= 10")], 1
    ):
        not_taken = " and ".join(
            f"not exists (select 1 from p{j} x where {cols(K.split(', '), 'x.{} = c.{}', ' and ')} and x.fingerprint = c.fingerprint)"
            for j in taken
        ) or "true"
        chain.append(
            f"p{i} AS (select *, '{name}' as category from c0 c where {cond} and {not_taken} "
            f"qualify row_number() over (partition by {K} order by {measure} desc, fingerprint) <= 25)"
        )
        taken.append(i)
    return ",\n".join(chain)


_stmt_fix = "statements_raw pg_database server_versions"
oracle("statement_stats", _stmt_fix, "select * from stmt", SCAN)
oracle("query_stats_delta", _stmt_fix, "select * from delta", SCAN, TEXT, DELTA)
oracle("query_stats_valid", _stmt_fix, "select * from valid", SCAN, TEXT, DELTA, VALID)
oracle("fingerprint_rollup", _stmt_fix, "select * from rolled", SCAN, TEXT, DELTA, VALID, ROLLED)
oracle("missing_text_placeholder", _stmt_fix, "select * from placed", SCAN, TEXT, DELTA, VALID, ROLLED, PLACED)
_union = "select * from p1 union all select * from p2 union all select * from p3 union all select * from p4"
oracle("worst_queries", _stmt_fix, _union, SCAN, TEXT, DELTA, VALID, ROLLED, worst("rolled"))
oracle(
    "top_queries", _stmt_fix,
    _union + " union all by name select *, 'missing_text' as category from placed where query = 'MISSING' and fingerprint = ''",
    SCAN, TEXT, DELTA, VALID, ROLLED, PLACED, worst("rolled").replace("c0 AS (select *", f"c0 AS (select {cols(STATS_ORDER)}"),
)

# ---- servers, settings, catalog -------------------------------------------------


def on(keys: str, a: str, b: str) -> str:
    return " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def pick(keys: str, a: str) -> str:
    return ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))


SYSTEM = "('pg_catalog', 'information_schema', 'pg_toast', 'heroku_ext')"

oracle(
    "server_identity", "config_vars",
    """select replace(replace(name, 'HEROKU_POSTGRESQL_', ''), '_URL', '') as config_name, name as config_var_name,
              list_last(string_split(value, '/')) as database,
              split_part(split_part(list_last(string_split(split_part(value, '/', 3), '@')), '/', 1), ':', 1) as host
       from config_vars where ends_with(name, '_URL') and starts_with(value, 'postgres://')""",
)

CONNECTIONS = f"""connections_m AS (
  select {pick(KA, 's')}, '' as entity, m.name, case m.name when 'connections.used' then coalesce(a.used, 0) else s.reserved end::double as value
  from (select *, try_cast(setting as int) as reserved from settings where name = 'superuser_reserved_connections') s
  left join (select {K}, count(*) as used from activity group by all) a on {on(K, 's', 'a')},
  (values ('connections.used'), ('connections.reserved')) m(name) where s.reserved is not null
)"""
oracle("connections_used", "activity settings", "select * from connections_m", CONNECTIONS)

VERSION = f"version_s AS (select {KA}, split_part(setting, ' ', 1) as version from settings where name = 'server_version')"
MAXCONN = f"maxconn_s AS (select {KA}, cast(setting as bigint) as max_connections from settings where name = 'max_connections')"
PLATFORM = f"""platform_s AS (
  select {KA}, case when count(*) filter (where schema_name = 'heroku_ext') > 0 then 'heroku' else 'unknown' end as platform
  from schemata group by all)"""
oracle("max_connections", "settings", "select * from maxconn_s", MAXCONN)
oracle("server_version", "settings", "select * from version_s", VERSION)
oracle("platform_flag", "schemata", "select * from platform_s", PLATFORM)

POOLER_META = f"""first_look AS (
  select {S}, min(poll_seq) as poll_seq from pooler_versions group by all
), pool_last AS (
  select * from pooler_pools where db = database qualify row_number() over (partition by {K} order by ord desc) = 1
), limit_last AS (
  select * from pooler_databases where db = database qualify row_number() over (partition by {K} order by ord desc) = 1
), pooler_meta AS (
  select {S}, enabled, case when enabled then version else '' end as version,
         case when enabled then coalesce(max_connections, 0) else 0 end as max_server_connections
  from (select {pick(S, 'f')}, trim(replace(v.version, 'PgBouncer ', '')) as version, l.max_connections,
               trim(replace(v.version, 'PgBouncer ', '')) <> '' and coalesce(p.cl_active > 0 or p.cl_waiting > 0 or p.sv_active > 0, false) as enabled
        from first_look f join pooler_versions v on {on(K, 'f', 'v')}
        left join pool_last p on {on(K, 'f', 'p')} left join limit_last l on {on(K, 'f', 'l')}) x
)"""
_pooler_fix = "pooler_versions pooler_pools pooler_databases"
oracle("pooler_metadata", _pooler_fix, "select * from pooler_meta", POOLER_META)

oracle(
    "server_metadata", "polls_table settings schemata " + _pooler_fix,
    f"""select {pick(KA, 'p')},
       coalesce((select arg_min(version, poll_seq) from version_s x where {on(S, 'x', 'p')} and version <> '' and x.poll_seq <= p.poll_seq), '') as version,
       coalesce((select arg_min(max_connections, poll_seq) from maxconn_s x where {on(S, 'x', 'p')} and max_connections <> 0 and x.poll_seq <= p.poll_seq), 0) as max_connections,
       coalesce((select arg_min(platform, poll_seq) from platform_s x where {on(S, 'x', 'p')} and x.poll_seq <= p.poll_seq), '') as platform,
       p.measured_at as monitored_at,
       case when m.version <> '' then m.max_server_connections end as pooler_limit,
       case when m.version <> '' then m.version end as pooler_version
     from polls_table p left join pooler_meta m on {on(S, 'p', 'm')}""",
    VERSION, MAXCONN, PLATFORM, POOLER_META,
)

SCHEMAS = rf"""user_schemas AS (
  select {KA}, schema_name from schemata
  where schema_name not in {SYSTEM} and schema_name not like 'pg_toast_temp_%' and schema_name not like 'pg_temp_%')"""
oracle("schemata_user", "schemata", "select * from user_schemas", SCHEMAS)

SIZES = f"""sizes AS (
  select {pick(KA, 'c')}, n.nspname as schema, c.relname as name, coalesce(total_bytes, 0) as total_bytes_total,
         coalesce(index_bytes, 0) as index_bytes_total, coalesce(toast_bytes, 0) as toast_bytes_total,
         coalesce(total_bytes, 0) - coalesce(index_bytes, 0) - coalesce(toast_bytes, 0) as table_bytes_total
  from pg_class c left join pg_namespace n on {on(K, 'c', 'n')} and n.oid = c.relnamespace
  where relkind = 'r' and nspname not in {SYSTEM})"""
oracle("table_sizes", "pg_class pg_namespace", "select * from sizes", SIZES)

COLUMNS = f"""cols AS (
  select {KA}, table_schema as schema, table_name, column_name as name, column_default as default, data_type as type,
         is_nullable as nullable, character_maximum_length as max_length,
         case when data_type = 'numeric' then numeric_precision end as precision,
         case when data_type = 'numeric' then numeric_scale end as scale, interval_type, is_identity
  from columns where table_schema not in {SYSTEM})"""
COLUMNS = COLUMNS.replace("as default,", 'as "default",')
oracle("table_columns", "columns", "select * from cols", COLUMNS)

_stat_map = {
    "sequential_scans": "seq_scan", "sequential_scan_read_rows": "seq_tup_read", "index_scans": "idx_scan",
    "index_scan_read_rows": "idx_tup_fetch", "inserted_rows": "n_tup_ins", "updated_rows": "n_tup_upd",
    "deleted_rows": "n_tup_del", "live_row_estimate_total": "n_live_tup", "dead_row_estimate_total": "n_dead_tup",
    "modified_rows_since_analyze": "n_mod_since_analyze", "vacuum_count": "vacuum_count",
    "autovacuum_count": "autovacuum_count", "analyze_count": "analyze_count", "autoanalyze_count": "autoanalyze_count",
    "blocks_read": "heap_blks_read", "blocks_hit": "heap_blks_hit", "index_blocks_read": "idx_blks_read",
    "index_blocks_hit": "idx_blks_hit",
}
_toast_map = {
    "toast_blocks_read": "toast_blks_read", "toast_blocks_hit": "toast_blks_hit",
    "toast_index_blocks_read": "tidx_blks_read", "toast_index_blocks_hit": "tidx_blks_hit",
}
_time_map = {f"last_{k}_at": f"last_{k}" for k in ("vacuum", "autovacuum", "analyze", "autoanalyze")}
TSTATS = f"""tstats AS (
  select {pick(KA, 's')}, s.schemaname as schema, s.relname as name,
         {', '.join(f'{v} as {k}' for k, v in _stat_map.items())},
         {', '.join(f'coalesce({v}, 0) as {k}' for k, v in _toast_map.items())},
         {', '.join(f'cast(round(epoch({v})) as bigint) as {k}' for k, v in _time_map.items())}
  from table_stat s join table_statio o on {on(K, 's', 'o')} and s.relid = o.relid
  where s.schemaname not in {SYSTEM} and {' and '.join(f'{v} is not null' for v in _stat_map.values())})"""
oracle("table_stats", "table_stat table_statio", "select * from tstats", TSTATS)

# relations with the schema they live in, for both the index and the table it covers
RELATIONS = f"""relations AS (
  select {K}, oid, relname, total_bytes, nspname from pg_class
  join (select {K}, oid as relnamespace, nspname from pg_namespace) using ({K}, relnamespace))"""
INDEXES = RELATIONS + f""", used AS (
  select {KA}, indexrelid, idx_scan as scans, o.idx_blks_read as blocks_read, o.idx_blks_hit as blocks_hit
  from index_stat join index_statio o using ({KA}, indexrelid)
  where idx_scan + o.idx_blks_read + o.idx_blks_hit is not null
), indexes AS (
  select {KA}, own.nspname as schema, covered.relname as table_name, own.relname as name, indisunique as "unique",
         indisvalid as valid, own.total_bytes as bytes_total, scans, blocks_read, blocks_hit, indexdef as definition
  from used
  join pg_index using ({KA}, indexrelid)
  join relations own on {on(K, 'used', 'own')} and own.oid = used.indexrelid
  join pg_indexes d on {on(K, 'used', 'd')} and d.indexname = own.relname
  join relations covered on {on(K, 'used', 'covered')} and covered.oid = indrelid and covered.nspname not in {SYSTEM})"""
_index_fix = "pg_index pg_class pg_namespace index_stat index_statio pg_indexes"
oracle("index_stats", _index_fix, "select * from indexes", INDEXES)

UNUSED = f"""droppable AS (
  select {K}, indexrelid from pg_index where indisunique = false and len(list_filter(indkey, lambda k: k = 0)) = 0
  except select {K}, conindid from pg_constraint
), unused AS (
  select {KA}, schemaname as schema, relname as table_name, indexrelname as name
  from droppable join index_stat using ({K}, indexrelid) where idx_scan = 0)"""
oracle("unused_indexes", "index_stat pg_index pg_constraint", "select * from unused", UNUSED)

FLAGGED = f"""flagged AS (
  select i.*, exists (select 1 from unused u where {on(K, 'u', 'i')} and u.schema = i.schema and u.name = i.name) as unused
  from indexes i)"""
oracle("index_unused_flag", _index_fix + " pg_constraint", "select * from flagged", INDEXES, UNUSED, FLAGGED)

# hits and reads of each side on its own; a rate needs both sides to exist
CACHE = f"""side AS (
  select {KA}, 'index' as kind, sum(idx_blks_hit) as hit, sum(idx_blks_hit + idx_blks_read) as total from index_statio group by all
  union all select {KA}, 'table', sum(heap_blks_hit), sum(heap_blks_read) + sum(heap_blks_hit) from table_statio group by all
), cache_x AS (
  select {KA}, max(hit::double / nullif(total, 0)::double) filter (where kind = 'index') as index_rate,
         max(hit::double / nullif(total, 0)::double) filter (where kind = 'table') as table_rate
  from side group by all having count(*) = 2
), cache_m AS (
  select {KA}, '' as entity, 'cache.index.hit.rate' as name, index_rate as value from cache_x where index_rate is not null
  union all select {KA}, '', 'cache.table.hit.rate', table_rate from cache_x where table_rate is not null)"""
oracle("cache_hit_rates", "index_statio table_statio", "select * from cache_m", CACHE)

oracle(
    "settings_snapshot", "settings",
    f"""select {KA}, name, setting as value, unit, category, short_desc || ' ' || coalesce(extra_desc, '') as description,
               context, vartype as var_type, source, min_val, max_val, enumvals as enum_vals, boot_val, reset_val, pending_restart
        from settings""",
)

# ---- replication ------------------------------------------------------------------


def lsn(x: str) -> str:
    return f"(('0x' || split_part({x}, '/', 1))::hugeint * 4294967296 + ('0x' || split_part({x}, '/', 2))::hugeint)"


_lags = {"write": ("sent_lsn", "write_lsn"), "flush": ("write_lsn", "flush_lsn"), "replay": ("flush_lsn", "replay_lsn")}
CLIENTS = f"""clients AS (
  select * from (
    select {KA}, ord,
      coalesce(application_name || case when backend_start is null then '' else ':' || cast(cast(floor(epoch(backend_start)) as bigint) as string) end, '') as application_name,
      client_addr, client_hostname, client_port, cast(floor(epoch(backend_start)) as bigint) as backend_start, backend_xmin, state,
      write_lag, flush_lag, replay_lag,
      {', '.join(f'cast({lsn(a)} - {lsn(b)} as double) as {k}_lag_bytes' for k, (a, b) in _lags.items())},
      sync_priority, sync_state
    from replication_clients) c
  where write_lag_bytes is not null and flush_lag_bytes is not null and replay_lag_bytes is not null)"""
_parts = ", ".join(f"{k}_lag.{p} as {k}_lag_{p}" for k in _lags for p in ("months", "days", "micros"))
oracle("replica_clients", "replication_clients", f"select * exclude (write_lag, flush_lag, replay_lag), {_parts} from clients", CLIENTS)


def conn_value(key: str) -> str:
    words = f"list_filter(list_transform(string_split(conninfo, ' '), lambda w: string_split(w, '=')), lambda kv: len(kv) > 1 and kv[1] = '{key}')"
    return f"coalesce(list_last({words})[2], '')"


SELF = f"""self AS (
  select {KA}, application_name || coalesce(':' || cast(started as string), '') as application_name, primary_host,
         coalesce((select arg_min(config_name, ord) from known_servers k where k.host = w.primary_host), '') as primary_config_name,
         status, lag
  from (select w.*, {conn_value('host')} as primary_host, {conn_value('application_name')} as application_name,
               (select cast(floor(epoch(arg_min(backend_start, pid))) as bigint) from activity a
                where {on(K, 'a', 'w')} and backend_type = 'walreceiver') as started
        from wal_receiver w where conninfo <> '' and status is not null) w)"""
oracle(
    "replica_self", "wal_receiver activity known_servers",
    "select * exclude (lag), lag.months as lag_months, lag.days as lag_days, lag.micros as lag_micros from self", SELF,
)


def ms(x: str) -> str:
    return f"cast(trunc({x}.micros / 1000) as double)"


_lag_metrics = [(f"replication.standby.lag.{k}.ms", ms(f"{k}_lag"), f"{k}_lag is not null") for k in _lags]
_lag_metrics += [(f"replication.standby.lag.{k}.bytes", f"{k}_lag_bytes", "true") for k in _lags]
LAGS = "lags AS (" + " union all ".join(
    [f"select {KA}, 'replication.standby.lag.local.ms' as name, 'replica/standby/' || application_name as entity, {ms('lag')} as value from self where lag is not null"]
    + [f"select {KA}, '{n}', 'replica/standby/' || application_name, {v} from clients where {c}" for n, v, c in _lag_metrics]
) + ")"
_repl_fix = "wal_receiver activity known_servers replication_clients"
oracle("replication_lag_metrics", _repl_fix, "select * from lags", CLIENTS, SELF, LAGS)

# ---- pooler and database counters ---------------------------------------------------

PTOTALS = f"""ptotals AS (
  select {KA}, xact_count, query_count, bytes_received, bytes_sent, xact_time / 1000 as xact_time,
         query_time / 1000 as query_time, wait_time / 1000 as wait_time
  from pooler_totals where db = database qualify row_number() over (partition by {K} order by ord desc) = 1)"""
oracle("pooler_totals", "pooler_totals", "select * from ptotals", PTOTALS)


def union_metrics(source: str, metrics: dict[str, str], entity: str = "''") -> str:
    return " union all ".join(
        f"select {KA}, {entity} as entity, '{n}' as name, cast({v} as double) as value from {source}" for n, v in metrics.items()
    )


PPOOLS = "ppools AS (" + union_metrics(
    f"(select * from pool_last p where exists (select 1 from pooler_meta m where {on(S, 'm', 'p')} and m.enabled))",
    {"pgbouncer.connections.client.active": "cl_active", "pgbouncer.connections.client.waiting": "cl_waiting",
     "pgbouncer.connections.server.active": "sv_active", "pgbouncer.connections.server.idle": "sv_idle",
     "pgbouncer.wait.time.max": "maxwait"},
) + ")"
oracle("pooler_pools", _pooler_fix, "select * from ppools", POOLER_META, PPOOLS)


def lag_delta(source: str, out: str, counters: list[str]) -> str:
    return f"""{out} AS (
      select {KA}, {', '.join(f'{c} - p_{c} as {c}' for c in counters)}
      from (select *, {', '.join(f'lag({c}) over w as p_{c}' for c in counters)}, row_number() over w as rn
            from {source} window w as (partition by {S} order by poll_seq)) z where rn > 1)"""


_pc = "xact_count query_count bytes_received bytes_sent xact_time query_time wait_time".split()
PDELTA = lag_delta(
    f"(select * from ptotals p where exists (select 1 from pooler_meta m where {on(S, 'm', 'p')} and m.enabled))", "pd", _pc
) + ", pdelta AS (" + union_metrics("pd", {
    "pgbouncer.transactions": "xact_count", "pgbouncer.queries": "query_count", "pgbouncer.received.bytes": "bytes_received",
    "pgbouncer.sent.bytes": "bytes_sent", "pgbouncer.transactions.time": "xact_time",
    "pgbouncer.transactions.time.avg": ratio4("xact_time", "xact_count"), "pgbouncer.queries.time": "query_time",
    "pgbouncer.queries.time.avg": ratio4("query_time", "query_count"), "pgbouncer.wait.time": "wait_time",
}) + ")"
oracle("pooler_delta", "pooler_totals " + _pooler_fix, "select * from pdelta", POOLER_META, PTOTALS, PDELTA)

_dc = ("xact_commit xact_rollback blks_read blks_hit tup_returned tup_fetched tup_inserted tup_updated tup_deleted "
       "conflicts temp_files temp_bytes deadlocks blk_read_time blk_write_time").split()
DDELTA = lag_delta("db_stats", "dd", _dc) + ", ddelta AS (" + union_metrics("dd", {
    "query.transactions.committed": "xact_commit", "query.transactions.rolledback": "xact_rollback",
    "query.rows.returned": "tup_returned", "query.rows.fetched": "tup_fetched", "query.rows.inserted": "tup_inserted",
    "query.rows.updated": "tup_updated", "query.rows.deleted": "tup_deleted", "query.conflicts": "conflicts",
    "query.deadlocks": "deadlocks", "disk.temp.files": "temp_files", "disk.temp.bytes": "temp_bytes",
    "disk.io.blocks.read": "blks_read", "disk.io.blocks.hit": "blks_hit",
    "disk.io.blocks.hit.percent": hit("blks_hit", "blks_read"),
    "disk.io.blocks.read.time": "blk_read_time", "disk.io.blocks.write.time": "blk_write_time",
}, "'database/' || database") + ")"
oracle("database_delta", "db_stats", "select * from ddelta", DDELTA)

# ---- bloat -----------------------------------------------------------------------------

# widths are rounded up to a multiple of 4 bytes; a tuple header takes 24 of them
BCOLS = f"""bcols AS (
  select {K}, schemaname, tablename, sum(avg_width * (1 - null_frac)) as datawidth, max(null_frac) as maxfracsum,
         24 + count(*) filter (where null_frac <> 0) // 8 as nullhdr
  from pg_stats group by all)"""
BINFO = f"""btab AS (
  select {pick(KA, 'c')}, schemaname, tablename, c.oid, relpages, reltuples,
         24 + datawidth as datahdr, 4 * ceil(nullhdr / 4) * maxfracsum as nullhdr2
  from pg_class c
  join (select {K}, oid as relnamespace, nspname as schemaname from pg_namespace) using ({K}, relnamespace)
  join bcols using ({K}, schemaname)
  where tablename = relname and schemaname not in ('pg_catalog', 'information_schema', 'pg_toast'))"""


def bloat_ratio(pages: str, expected: str, zero: str) -> str:
    # half away from zero on the exact quotient: integers only
    p, e = f"cast({pages} as hugeint)", f"cast({expected} as hugeint)"
    sign = f"(case when {e} < 0 then -1 else 1 end)"
    return (
        f"(case when {zero} then 0.0e0 else {sign} * (cast((20 * {p} + abs({e})) // (2 * abs({e})) as double) / 10.0e0) end)"
    )


BTABLES = f"""btables AS (
  select {KA}, 'table' as type, schemaname, tablename as name, {bloat_ratio('relpages', 'otta', 'otta = 0')} as bloat,
         8192 * greatest(relpages - otta, 0) as waste
  from (select *, cast(ceil(reltuples * (4 * ceil(datahdr / 4) + nullhdr2 + 4) / 8172.0e0) as bigint) as otta
        from btab) t)"""
BINDEXES = f"""isize AS (
  select {K}, oid as indexrelid, relname, relpages as ipages, reltuples as ituples from pg_class
), bindexes AS (
  select {KA}, 'index' as type, schemaname, relname as name, {bloat_ratio('ipages', 'iotta', 'iotta = 0 or ipages = 0')} as bloat,
         8192 * greatest(ipages - iotta, 0) as waste
  from (select {pick(KA, 'btab')}, schemaname, isize.relname, ipages,
               cast(ceil(ituples * (datahdr - 12) / 8172.0e0) as bigint) as iotta
        from pg_index i join isize using ({K}, indexrelid) join btab on {on(K, 'i', 'btab')} and btab.oid = i.indrelid))"""
BLOAT = "bloat AS (select * from btables union select * from bindexes)"
oracle("bloat_columns", "pg_stats", "select * from bcols", BCOLS)
oracle("bloat_tables", "pg_stats pg_class pg_namespace", "select * from btables", BCOLS, BINFO, BTABLES)
oracle("bloat_indexes", "pg_stats pg_class pg_namespace pg_index", "select * from bindexes", BCOLS, BINFO, BINDEXES)
_bloat_fix = "pg_stats pg_class pg_namespace pg_index"
_bloat = (BCOLS, BINFO, BTABLES, BINDEXES, BLOAT)
oracle("bloat_report", _bloat_fix, "select * from bloat", *_bloat)

# ---- stitching and growth ------------------------------------------------------------------

oracle(
    "attach_columns", "pg_class pg_namespace columns",
    f"""select {pick(K, 's')}, s.schema, s.name, cast(count(c.name) as int) as n_columns,
               string_agg(c.name || ':' || c.type || coalesce(':' || cast(c.precision as string), ''), ',' order by c.name) as column_list
        from sizes s left join cols c on {on(K, 's', 'c')} and c.schema = s.schema and c.table_name = s.name
        group by all""",
    SIZES, COLUMNS,
)
_counters = [*_stat_map, *_toast_map]
WITH_STATS = f"""with_stats AS (
  select s.*, {', '.join(f'coalesce(t.{c}, 0) as {c}' for c in _counters)}, {', '.join(f't.{c}' for c in _time_map)}
  from sizes s left join tstats t on {on(K, 's', 't')} and t.schema = s.schema and t.name = s.name)"""
oracle("attach_table_stats", "pg_class pg_namespace table_stat table_statio", "select * from with_stats", SIZES, TSTATS, WITH_STATS)

LAST_BLOAT = f"""last_bloat AS (
  select * from bloat qualify row_number() over (partition by {K}, type, schemaname, name order by waste, bloat) = 1)"""


def with_bloat(source: str, kind: str) -> str:
    return (
        f"(select o.*, coalesce(b.waste, 0) as bloat_bytes_total, coalesce(b.bloat, 0) as bloat_factor from {source} o "
        f"left join last_bloat b on {on(K, 'o', 'b')} and b.type = '{kind}' and b.schemaname = o.schema and b.name = o.name)"
    )


oracle(
    "attach_bloat", _index_fix + " pg_stats",
    f"""select 'table' as kind, {K}, schema, name, bloat_bytes_total, bloat_factor from {with_bloat('sizes', 'table')} t
        union all select 'index', {K}, schema, name, bloat_bytes_total, bloat_factor from {with_bloat('indexes', 'index')} i""",
    SIZES, INDEXES, *_bloat, LAST_BLOAT,
)
oracle(
    "schema_tree", _index_fix + " schemata",
    f"""select {pick(K, 'u')}, u.schema_name as schema, t.name as table_name, t.total_bytes_total,
          (select string_agg(i.name, ',' order by i.name) from indexes i
           where {on(K, 'i', 't')} and i.schema = t.schema and i.table_name = t.name) as index_names
        from user_schemas u left join sizes t on {on(K, 'u', 't')} and t.schema = u.schema_name""",
    SCHEMAS, SIZES, INDEXES,
)

TDELTA = f"""tobj AS (
  select * from {with_bloat('with_stats', 'table')} t
  where exists (select 1 from user_schemas u where {on(K, 'u', 't')} and u.schema_name = t.schema)
), tdelta AS (
  select *, {hit('blocks_hit', 'blocks_read')} as blocks_hit_percent from (
    select {pick(KA, 'n')}, n.schema, n.name,
      {', '.join(f'n.{t}_bytes_total - p.{t}_bytes_total as {t}_bytes' for t in ('total', 'index', 'toast', 'table'))},
      n.total_bytes_total, n.index_bytes_total, n.toast_bytes_total, n.table_bytes_total, n.bloat_bytes_total,
      n.live_row_estimate_total, n.dead_row_estimate_total,
      case when n.bloat_bytes_total > p.bloat_bytes_total then n.bloat_bytes_total - p.bloat_bytes_total else 0 end as bloat_bytes,
      n.bloat_factor, n.live_row_estimate_total - p.live_row_estimate_total as live_row_estimate,
      case when n.dead_row_estimate_total > p.dead_row_estimate_total then n.dead_row_estimate_total - p.dead_row_estimate_total else 0 end as dead_row_estimate,
      n.modified_rows_since_analyze, {', '.join(f'n.{c}' for c in _time_map)},
      {', '.join(f'n.{c} - p.{c} as {c}' for c in _counters if 'estimate' not in c and not c.startswith('modified'))}
    from tobj n join tobj p on {on(S, 'n', 'p')} and n.schema = p.schema and n.name = p.name and n.poll_seq = p.poll_seq + 1) d)"""
_t_fix = "pg_class pg_namespace table_stat table_statio pg_stats pg_index schemata"
_t_ctes = (SIZES, TSTATS, WITH_STATS, *_bloat, LAST_BLOAT, SCHEMAS, TDELTA)
oracle("table_delta", _t_fix, "select * from tdelta", *_t_ctes)

IDELTA = f"""iobj AS (select * from {with_bloat('flagged', 'index')} i), idelta AS (
  select {pick(KA, 'n')}, n.schema, n.table_name, n.name, n."unique", n.unused, n.valid, n.definition,
         n.bytes_total - p.bytes_total as bytes, n.bytes_total,
         greatest(n.bloat_bytes_total - p.bloat_bytes_total, 0) as bloat_bytes, n.bloat_bytes_total, n.bloat_factor,
         n.scans - p.scans as scans, n.blocks_read - p.blocks_read as blocks_read, n.blocks_hit - p.blocks_hit as blocks_hit
  from iobj n join iobj p on {on(S, 'n', 'p')} and n.schema = p.schema and n.table_name = p.table_name and n.name = p.name
   and n.poll_seq = p.poll_seq + 1)"""
_i_fix = _index_fix + " pg_constraint pg_stats"
_i_ctes = (INDEXES, UNUSED, FLAGGED, *_bloat, LAST_BLOAT, IDELTA)
oracle("index_delta", _i_fix, "select * from idelta", *_i_ctes)
oracle(
    "schema_report_gate", _t_fix,
    f"""select {pick(KA, 'u')}, u.schema_name as schema, d.name, d.total_bytes, d.dead_row_estimate
        from (select *, min(poll_seq) over (partition by {S}) as first_poll from user_schemas) u
        left join tdelta d on {on(K, 'u', 'd')} and d.schema = u.schema_name where u.poll_seq > u.first_poll""",
    *_t_ctes,
)

# ---- scalar functions ------------------------------------------------------------------

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_v = "l_extendedprice / 7.0e0 * l_discount"
oracle("fn_round_up", "", f"select {LINE}, {up(_v, 2)} as up2, {up(_v, 4)} as up4 from lineitem")
oracle("fn_ratio4", "", f"select {LINE}, {ratio4('l_extendedprice', 'l_discount')} as ratio from lineitem")
oracle("fn_hit_ratio", "", f"select {LINE}, {hit('(l_partkey % 50)', '(l_suppkey % 10)')} as ratio from lineitem")

_nums = "list_transform(string_split({c}, '.'), lambda x: cast(x as bigint)) || [0, 0, 0]"
_ok = r"regexp_matches({c}, '^[0-9]+(\.[0-9]+)*$')"
_cmp = (
    f"case when not {_ok.format(c='left_version')} or not {_ok.format(c='right_version')} then null "
    "when l < r then -1 when l > r then 1 else 0 end"
)
oracle(
    "fn_version_cmp", "versions",
    f"""select {LINE}, cmp, coalesce(cmp > 0, false) as gt, coalesce(cmp >= 0, false) as gte
        from (select *, {_cmp} as cmp from (
          select *, case when {_ok.format(c='left_version')} then ({_nums.format(c='left_version')})[1:3] end as l,
                    case when {_ok.format(c='right_version')} then ({_nums.format(c='right_version')})[1:3] end as r from versions) n) c""",
)


def text_oracle(name: str, select: str, where: str = "true") -> None:
    oracle(name, "corpus", f"select row_key{select} from corpus where {where}")


text_oracle("fn_clean_query", f", {clean('text')} as cleaned")
text_oracle("fn_parse_comment", f", {comment('text')} as comment, {strip('text')} as query")
text_oracle("fn_redact_ip", f", {redact('text')} as redacted")
text_oracle("fn_obfuscate_query", f", {obfuscate('text')} as obfuscated")
text_oracle("fn_truncate_query", f", {truncate('text', 5000)} as truncated")
text_oracle("fn_is_collector_query", "", f"not contains({comment('text')}, '{COLLECTOR}')")
oracle(
    "fn_fingerprint", "corpus",
    f"select substr(md5({clean(obfuscate(strip('text')))}), 1, 10) as fingerprint, count(*) as n from corpus group by 1",
)
oracle(
    "fn_missing_text", "statements_raw", f"select {K}, ord, query, fingerprint from norm",
    f"stmt AS (select {KA}, ord, query_id, query, min_time, max_time, {cols(COUNTERS)} from statements_raw)", TEXT,
)
EXPLAIN = r"(?i)((?:=|>|<|~~|ANY \()\s*)" + PARAM


def explain(x: str) -> str:
    line = f"case when regexp_matches(l, '(?i)(Cond:|Filter:)') then regexp_replace(l, {q(EXPLAIN)}, '\\1?', 'g') else l end"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {line}), chr(10))"


oracle("fn_obfuscate_explain", "explain_events", f"select event_id, {explain('plan')} as plan from explain_events")
oracle(
    "fn_conninfo", "conninfos",
    f"select c_custkey, {conn_value('host')} as host, {conn_value('application_name')} as application_name from conninfos",
)
oracle(
    "fn_lsn_diff", "replication_clients",
    f"select {K}, ord, cast({lsn('sent_lsn')} - {lsn('replay_lsn')} as double) as bytes from replication_clients",
)
oracle(
    "fn_interval_ms", "replication_clients",
    f"select {K}, ord, {ms('write_lag')} as write_ms, {ms('replay_lag')} as replay_ms from replication_clients",
)

# ---- logs ----------------------------------------------------------------------------------

SYSLOG = r"\d+ <\d+>\d+ (.*) host app (\w+(?:\.|-)\w+) -\s?\[?(\w+)?\]?\s?\[?(\d+)?(?:-\d+)?\]? (.*)"
SLOW = r"sql_error_code = (\d+)\s*(.*)\s*LOG:\s+duration:\s+(\d+\.\d+) ms\s+execute <\w+>: (.*)"
LINES = """lines AS (
  select payload_id, received_at, cast(pos - 1 as int) as pos, line
  from (select payload_id, received_at, unnest(string_split(body, chr(10))) as line,
               generate_subscripts(string_split(body, chr(10)), 1) as pos from log_payloads) u)"""


def group(x: str, pattern: str, n: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {n})"


SYS = f"""sys AS (
  select payload_id, received_at, pos, {group('line', SYSLOG, 1)} as timestamp, {group('line', SYSLOG, 2)} as process,
         {group('line', SYSLOG, 3)} as color, {group('line', SYSLOG, 4)} as segment, {group('line', SYSLOG, 5)} as message
  from lines where regexp_matches(line, {q(SYSLOG)}))"""


def stamp(x: str, received: str = "received_at") -> str:
    return f"coalesce(cast(floor(epoch(try_strptime({x}, '%Y-%m-%dT%H:%M:%S%z'))) as bigint), cast(floor(epoch({received})) as bigint))"


def slow_fields(x: str) -> str:
    return (
        f"{group(x, SLOW, 1)} as sql_error_code, {trim_ws(group(x, SLOW, 2))} as metadata, "
        f"cast({group(x, SLOW, 3)} as double) as duration_ms, {group(x, SLOW, 4)} as raw"
    )


def kv_rows(source: str, keep: str, message: str, at: str) -> str:
    """Key and value rows: last token of a key wins, the time stamp comes first."""
    return f"""select {keep}, key, value from (
      select {keep}, 0 as i, 'timestamp' as key, cast({at} as string) as value from {source}
      union all
      select {keep}, i, replace(kv[1], 'sample#', '') as key, kv[2] as value from (
        select {keep}, generate_subscripts(tokens, 1) as i, string_split(unnest(tokens), '=') as kv,
               unnest(tokens) as token
        from (select *, regexp_split_to_array({message}, {q(WS + '+')}) as tokens from {source}) t) k
      where len(kv) = 2 and octet_length(encode(token)) >= 2) z
      qualify row_number() over (partition by {keep}, key order by i desc) = 1"""


PRE = """pre AS (
  select * from log_payloads where contains(body, 'app postgres.') or contains(body, 'heroku-postgres') or contains(body, 'heroku-pgbouncer'))"""
PLINES = LINES.replace("from log_payloads)", "from pre)")
STITCH = """stitched AS (
  select payload_id, received_at, min(pos) as pos, process, segment, arg_min(color, pos) as color,
         arg_min(timestamp, pos) as timestamp, string_agg(message, '' order by pos) as message
  from sys where message <> '' group by payload_id, received_at, process, segment)"""
ROUTED = f"""routed AS (
  select *, case when process = 'heroku-postgres' then 'metric'
                 when starts_with(process, 'postgres.') and regexp_matches({trim_ws('message')}, {q(SLOW)}) then 'slow_query' end as branch
  from stitched)"""
_log = (PRE, PLINES, SYS, STITCH, ROUTED)

oracle("fn_syslog_line", "log_payloads", "select * exclude (received_at) from sys", LINES, SYS)
oracle("fn_log_timestamp", "log_payloads", f"select payload_id, pos, {stamp('timestamp')} as at from sys", LINES, SYS)
oracle(
    "fn_slow_query_line", "log_payloads",
    f"select payload_id, pos, {slow_fields(trim_ws('line'))} from lines where regexp_matches(line, {q(SLOW)})", LINES,
)
oracle(
    "fn_key_values", "log_payloads", kv_rows("lines", "payload_id, pos", "line", "cast(floor(epoch(received_at)) as bigint)"), LINES,
)
oracle(
    "fn_omit_empty", "columns",
    f"""select {K}, table_name, nullif(name, '') as name, nullif("default", '') as "default", nullif(type, '') as type,
          case when nullable = 'YES' then true end as nullable, nullif(max_length, 0) as max_length,
          nullif(precision, 0) as precision, nullif(scale, 0) as scale, nullif(interval_type, '') as interval_type,
          case when is_identity = 'YES' then true end as is_identity from cols""",
    COLUMNS,
)
oracle(
    "src_log_payloads", "log_payloads",
    """select payload_id, cast(floor(epoch(received_at)) as bigint) as received_at, cast(len(string_split(body, chr(10))) as int) as n_lines,
              octet_length(encode(body)) as n_bytes from log_payloads""",
)
oracle("log_prefilter", "log_payloads", "select payload_id from pre", PRE)
oracle(
    "log_test_marker", "log_payloads",
    """select cast(epoch(date_trunc('day', received_at)) as bigint) as report_start,
              cast(floor(epoch(arg_max(received_at, payload_id))) as bigint) as log_test_received_at
       from log_payloads where contains(body, 'NOTICE:  FLEET_COLLECTOR_LOG_TEST') group by 1""",
)
oracle("log_stitch", "log_payloads", "select * exclude (received_at) from stitched", PRE, PLINES, SYS, STITCH)
oracle("log_route", "log_payloads", "select payload_id, pos, branch from routed where branch is not null", *_log)
oracle("stream_logs", "log_payloads", "select payload_id, pos, branch from routed where branch is not null", *_log)
oracle(
    "log_metrics", "log_payloads",
    kv_rows("(select * from routed where branch = 'metric')", "payload_id, pos", "message", stamp("timestamp")), *_log,
)
SLOWQ = f"""slowq AS (
  select payload_id, received_at, pos, color, {stamp('timestamp')} as measured_at, {slow_fields(trim_ws('message'))}
  from routed where branch = 'slow_query'
), slow_text AS (
  select *, {clean(obfuscate(strip('raw')))} as cleaned from slowq where not contains({comment('raw')}, '{COLLECTOR}')
), slow_events AS (
  select v.config_name, v.config_var_name, v.database, measured_at, payload_id, pos, sql_error_code,
         substr(md5(cleaned), 1, 10) as fingerprint, {truncate('cleaned', 5000)} as query, raw,
         cast(1 as bigint) as calls, duration_ms as total_time, duration_ms as min_time, duration_ms as max_time, 0.0e0 as mean_time
  from slow_text t join (select * from servers qualify row_number() over (partition by config_name order by ord) = 1) v
    on v.config_name = t.color)"""
oracle("slow_query_events", "log_payloads servers", "select * from slow_events", *_log, SLOWQ)
def throttled(source: str, keys: list[str], where: str = "true") -> str:
    """First event of a key, then the first at least an hour after the last one taken."""
    k = cols(keys)
    later = f"select {{}} from short s where {on(k, 's', 'e')} and s.measured_at >= e.measured_at + 3600"
    return f"""short AS (
  select * from {source} where octet_length(encode(raw)) <= 30000 and {where}
), emitted AS (
  select {k}, min(measured_at) as measured_at from short group by all
  union all
  select {cols(['e.' + c for c in keys])}, ({later.format('min(s.measured_at)')}) from emitted e where exists ({later.format('1')})
)"""


_explain_keys = ["config_name", "fingerprint"]
for _key, _extra in (("explain_throttle", ""), ("stream_explain_throttle", ", false as behind")):
    oracle(
        _key, "explain_events",
        f"""select min(s.event_id) as event_id, {cols(['s.' + c for c in _explain_keys])}, s.measured_at,
              {explain('arg_min(s.plan, s.event_id)')} as plan{_extra}
            from short s join emitted e on {on(cols(_explain_keys), 's', 'e')} and s.measured_at = e.measured_at group by {cols(['s.' + c for c in _explain_keys])}, s.measured_at""",
        throttled("explain_events", _explain_keys),
    )
    ORACLES[_key] = ORACLES[_key].replace("WITH ", "WITH RECURSIVE ", 1)

PLAN_TEXT = f"""plan_text AS (
  select *, {clean(obfuscate(strip('raw')))} as cleaned from plan_events where not contains({comment('raw')}, '{COLLECTOR}')
), plan_keys AS (
  select v.config_name, v.config_var_name, v.database, substr(md5(cleaned), 1, 10) as fingerprint, measured_at, plan_id, raw, plan
  from plan_text t join (select * from servers qualify row_number() over (partition by config_name order by ord) = 1) v using (config_name))"""
_plan_keys = ["config_name", "config_var_name", "database", "fingerprint"]
PLANNED = f"""taken AS (
  select {cols(['s.' + c for c in _plan_keys])}, s.measured_at, min(plan_id) as plan_id, arg_min(plan, plan_id) as plan
  from short s join emitted e on {on(cols(_plan_keys), 's', 'e')} and s.measured_at = e.measured_at group by {cols(['s.' + c for c in _plan_keys])}, s.measured_at
), near AS (
  select e.payload_id, e.pos, {explain('p.plan')} as explain,
         row_number() over (partition by p.plan_id, {cols(['p.' + c for c in _plan_keys])} order by e.measured_at desc, e.payload_id, e.pos) as place
  from taken p join slow_events e on {on(cols(_plan_keys), 'p', 'e')} and e.measured_at between p.measured_at - 60 and p.measured_at
), explained AS (
  select e.*, n.explain from slow_events e left join (select * from near where place = 1) n using (payload_id, pos))"""
_summary = """select config_name, fingerprint, query, count(*) as calls, min(min_time) as min_time, max(max_time) as max_time,
              max(measured_at) as measured_at, count(explain) as n_plans, min(explain) as first_plan, max(explain) as last_plan
            from explained group by config_name, fingerprint, query"""
for _key, _select in (
    ("slow_query_report", _summary), ("stream_slow_query_report", _summary),
    ("slow_query_plans", f"select {cols(_plan_keys)}, payload_id, pos, measured_at, explain from explained where explain is not null"),
):
    oracle(_key, "log_payloads servers plan_events", _select, *_log, SLOWQ, PLAN_TEXT, throttled("plan_keys", _plan_keys), PLANNED)
    ORACLES[_key] = ORACLES[_key].replace("WITH ", "WITH RECURSIVE ", 1)
oracle(
    "collector_log_stats", "log_payloads",
    """select cast(epoch(date_trunc('hour', p.received_at)) as bigint) as report_start, count(*) as received,
         count(*) filter (where p.payload_id in (select payload_id from pre)) as postgres,
         cast(sum(coalesce(r.metric, 0) + coalesce(r.slow, 0)) as bigint) as handled, cast(sum(coalesce(r.metric, 0)) as bigint) as metric_lines,
         cast(sum(coalesce(r.slow, 0)) as bigint) as slow_queries
       from log_payloads p left join (
         select payload_id, count(*) filter (where branch = 'metric') as metric, count(*) filter (where branch = 'slow_query') as slow
         from routed group by 1) r using (payload_id) group by 1""",
    *_log,
)

# ---- metrics and folding ---------------------------------------------------------------------

oracle(
    "metric_series", "metrics_long",
    f"""select cast(measured_at // 60 * 60 as bigint) as report_start, config_name, name, entity,
               cast(row_number() over (partition by measured_at // 60, config_name, name, entity order by ord) - 1 as int) as pos,
               {up('value', 4)} as value, measured_at from metrics_long""",
)
_all_metrics = " union all by name ".join(
    f"select {KA}, name, entity, value from {s}" for s in ("connections_m", "ddelta", "cache_m", "pdelta", "ppools", "lags")
)
_metric_fix = f"activity settings db_stats index_statio table_statio pooler_totals {_pooler_fix} {_repl_fix}"
_metric_ctes = (CONNECTIONS, DDELTA, CACHE, POOLER_META, PTOTALS, PDELTA, PPOOLS, CLIENTS, SELF, LAGS)
oracle("metric_stream", _metric_fix, _all_metrics, *_metric_ctes)
oracle(
    "append_stats", _stmt_fix + " log_payloads servers",
    f"""select {S}, fingerprint, query, calls, total_time, measured_at from valid
        union all select {S}, fingerprint, query, calls, total_time, measured_at from slow_events""",
    SCAN, TEXT, DELTA, VALID, *_log, SLOWQ,
)
oracle(
    "error_cap", "errors",
    """select seq, cast(floor(epoch(event_time)) as bigint) as event_time, error, panic, stack_trace,
              cast(epoch(d) as bigint) as report_start
       from (select *, date_trunc('day', event_time) as d, row_number() over w as rn,
                    min(seq) filter (where panic) over (partition by date_trunc('day', event_time)) as first_panic
             from errors window w as (partition by date_trunc('day', event_time) order by seq)) e
       where rn <= 10 or seq = first_panic""",
)
oracle(
    "fold_servers", "server_records",
    """select config_name, config_var_name, arg_max(monitored_at, ord) as monitored_at,
         coalesce(arg_max(version, ord) filter (where version <> ''), '') as version,
         coalesce(arg_max(max_connections, ord) filter (where max_connections <> 0), 0) as max_connections,
         arg_min(platform, ord) as platform,
         (select s2.pooler.version from server_records s2 where s2.config_name = s.config_name and s2.config_var_name = s.config_var_name order by ord limit 1) as pooler_version,
         (select s2.pooler.max_server_connections from server_records s2 where s2.config_name = s.config_name and s2.config_var_name = s.config_var_name order by ord limit 1) as pooler_limit
       from server_records s group by config_name, config_var_name""",
)
oracle(
    "latest_database", "pg_class pg_namespace",
    f"select * from sizes s where poll_seq = (select max(poll_seq) from sizes x where {on(S, 'x', 's')})", SIZES,
)
oracle(
    "latest_replication", "wal_receiver activity known_servers",
    f"select * exclude (lag) from self qualify row_number() over (partition by {S} order by poll_seq desc) = 1", SELF,
)
oracle(
    "latest_settings", "settings",
    ORACLES["settings_snapshot"][ORACLES["settings_snapshot"].rindex("select " + KA):]
    + f" qualify row_number() over (partition by {S}, name order by poll_seq desc) = 1",
)
oracle(
    "report_window", "",
    """select cast(floor(epoch(ts) / 60) * 60 as bigint) as report_start, event_type, count(*) as n from events group by 1, 2""",
)

# ---- compositions -------------------------------------------------------------------------------

_common = f"{KA}, schema, name, bloat_bytes, bloat_bytes_total, bloat_factor, blocks_read, blocks_hit"
IHUNG = IDELTA.replace(
    f"select * from {with_bloat('flagged', 'index')} i",
    f"""select * from {with_bloat('flagged', 'index')} i
        where exists (select 1 from user_schemas u where {on(K, 'u', 'i')} and u.schema_name = i.schema)
          and exists (select 1 from sizes s where {on(K, 's', 'i')} and s.schema = i.schema and s.name = i.table_name)""",
)
oracle(
    "schema_health", _t_fix + " " + _i_fix,
    f"""select 'table' as kind, {_common}, total_bytes as bytes, total_bytes_total as bytes_total from tdelta
        union all select 'index', {_common}, bytes, bytes_total from idelta""",
    *_t_ctes, INDEXES, UNUSED, FLAGGED, IHUNG,
)
oracle(
    "src_snapshots", "index_statio",
    "select * from index_statio where idx_blks_read is not null and idx_blks_hit is not null",
)
oracle(
    "stream_counter_delta", _stmt_fix,
    f"""select {pick(KA, 'n')}, p.ord, n.query_id, n.calls - p.calls as calls, n.total_time - p.total_time as total_time, n.rows - p.rows as rows, false as behind
        from stmt p join (select * from stmt qualify row_number() over (partition by {K}, query_id order by ord) = 1) n
          on {on(S, 'p', 'n')} and p.query_id = n.query_id and n.poll_seq = p.poll_seq + 1""",
    SCAN,
)

AT = "(1700000000 + 60 * {d})"
_pay = "floor(payload_id / 2500)"
PAY = f"""pay AS (
  select *, 'collector_' || cast(payload_id // 2500 as string) as collector_id, {AT.format(d='day(received_at)')} as at_s from log_payloads)"""
REPORT = f"""wins AS (select collector_id, at_s // 60 * 60 as report_start, payload_id, at_s from pay
), r_logs AS (
  select collector_id, report_start, count(*) as n, string_agg(line, ';' order by at_s, payload_id, pos) as log_lines from (
    select w.collector_id, w.report_start, w.at_s, payload_id, v.pos, string_agg(v.key || '=' || v.value, ',' order by v.key) as line
    from wins w join metric_values v using (payload_id) group by all) group by all
), r_stats AS (
  select w.collector_id, w.report_start, count(distinct w.payload_id) as received, count(r.payload_id) as handled
  from wins w left join (select * from routed where branch is not null) r using (payload_id) group by all
), r_tests AS (
  select collector_id, at_s // 60 * 60 as report_start, arg_max(at_s, payload_id) as t from pay
  where contains(body, 'NOTICE:  FLEET_COLLECTOR_LOG_TEST') group by all
), r_errs AS (
  select collector_id, report_start, count(*) as n, string_agg(nullif(error, ''), ';' order by seq) as error_texts from (
    select *, row_number() over w as rn, min(seq) filter (where panic) over (partition by collector_id, report_start) as fp
    from (select *, 'collector_' || cast(seq // 10000 as string) as collector_id, ({AT.format(d='day(event_time)')}) // 60 * 60 as report_start from errors)
    window w as (partition by collector_id, report_start order by seq)) where rn <= 10 or seq = fp group by all
), r_servers AS (
  select 'collector_' || string_split(config_name, '_')[-1] as collector_id, measured_at // 60 * 60 as report_start,
         count(distinct config_name) as n, string_agg(distinct config_name, ',' order by config_name) as names
  from server_records group by all
)"""
METRIC_VALUES = "metric_values AS (" + kv_rows(
    "(select r.* replace (p.at_s as at_s) from (select *, 0 as at_s from routed where branch = 'metric') r join pay p using (payload_id))",
    "payload_id, pos", "message", stamp("timestamp", "to_timestamp(at_s)"),
) + ")"
for _key in ("report_document", "sink_report_json", "stream_fleet_report"):
    oracle(
        _key, "log_payloads errors server_records",
        """select collector_id, report_start, report_start + 60 as reported_at, cast(coalesce(l.n, 0) as int) as n_log_metrics,
             cast(coalesce(s.n, 0) as int) as n_servers, cast(coalesce(e.n, 0) as int) as n_errors,
             t.t as log_test_message_received_at, nullif(c.received, 0) as received, nullif(c.handled, 0) as handled, s.names as config_names,
             coalesce(l.log_lines, '') as log_lines, coalesce(e.error_texts, '') as error_texts
           from r_servers s full join r_logs l using (collector_id, report_start) full join r_tests t using (collector_id, report_start)
           full join r_stats c using (collector_id, report_start) full join r_errs e using (collector_id, report_start)
           where l.n > 0 or s.n > 0 or t.t is not null""",
        *_log, PAY, METRIC_VALUES, REPORT,
    )

METADATA = f"""meta AS ({ORACLES['server_metadata'][ORACLES['server_metadata'].rindex('select ' + pick(KA, 'p')):]})"""
oracle(
    "servers_enriched", f"polls_table settings schemata {_pooler_fix} activity {_repl_fix} {_stmt_fix} log_payloads servers plan_events",
    f"""select m.poll_seq, m.config_name, m.config_var_name, nullif(m.platform, '') as platform, nullif(m.max_connections, 0) as max_connections,
         m.version, m.monitored_at,
         cast(coalesce((select count(distinct database) from user_schemas x where x.poll_seq = m.poll_seq and x.config_name = m.config_name and m.poll_seq > 1), 0) as int) as n_databases,
         (select string_agg(schema_name, ',' order by schema_name) from user_schemas x where x.poll_seq = m.poll_seq and x.config_name = m.config_name and m.poll_seq > 1) as schema_names,
         (select nullif(arg_max(application_name, database), '') from self x where x.poll_seq = m.poll_seq and x.config_name = m.config_name) as replica_name,
         cast((select count(*) from clients x where x.poll_seq = m.poll_seq and x.config_name = m.config_name) as int) as n_replicas,
         cast((select count(distinct (name, entity)) from connections_m x where x.poll_seq = m.poll_seq and x.config_name = m.config_name) as int) as n_metrics,
         cast((select count(*) from reported x where x.poll_seq = m.poll_seq and x.config_name = m.config_name) as int) as n_queries,
         coalesce((select max({up('total_time', 2)}) from reported x where x.poll_seq = m.poll_seq and x.config_name = m.config_name), 0.0e0) as max_time,
         cast((select count(*) from settings x where x.poll_seq = m.poll_seq and x.config_name = m.config_name) as int) as n_settings,
         coalesce((select string_agg(explain, ';' order by explain) from reported x where x.poll_seq = m.poll_seq and x.config_name = m.config_name), '') as explains
       from meta m""",
    VERSION, MAXCONN, PLATFORM, POOLER_META, METADATA, SCHEMAS, CLIENTS, SELF, CONNECTIONS,
    SCAN, TEXT, DELTA, VALID, ROLLED, PLACED, worst("rolled").replace("c0 AS (select *", f"c0 AS (select {cols(STATS_ORDER)}"),
    "tops AS (" + _union + " union all by name select *, 'missing_text' as category from placed where query = 'MISSING' and fingerprint = '')",
    *_log, SLOWQ, PLAN_TEXT, throttled("plan_keys", _plan_keys), PLANNED,
    """reported AS (
  select poll_seq, config_name, total_time, cast(null as varchar) as explain from tops
  union all select payload_id % 5 + 1, config_name, total_time, explain from explained)""",
)
ORACLES["servers_enriched"] = ORACLES["servers_enriched"].replace("WITH ", "WITH RECURSIVE ", 1)

_fields = ["total_bytes", "index_bytes", "toast_bytes", "table_bytes", "total_bytes_total", "index_bytes_total", "toast_bytes_total",
           "table_bytes_total", "bloat_bytes_total", "live_row_estimate_total", "dead_row_estimate_total", "bloat_bytes", "bloat_factor",
           "live_row_estimate", "dead_row_estimate", "modified_rows_since_analyze", "blocks_hit_percent", *_time_map,
           *[c for c in _counters if "estimate" not in c and not c.startswith("modified")]]


def zeros(names, table: str = "") -> str:
    return ", ".join(f'nullif({table}{n}, 0) as {n}' for n in names)


def blanks(names) -> str:
    return ", ".join(f"nullif({n}, '') as {n}" for n in names)


def owned(names) -> str:
    return ", ".join(f"{n} as of_{n}" for n in names)


# ---- report fields --------------------------------------------------------------------------------

_K = K.split(", ")
oracle(
    "report_settings", "settings",
    f"""select {owned(_K)}, {blanks(['name', 'value', 'unit', 'category', 'description', 'context', 'var_type', 'source', 'min_val', 'max_val', 'enum_vals', 'boot_val', 'reset_val'])},
               pending_restart from ({ORACLES['settings_snapshot'][ORACLES['settings_snapshot'].rindex('select ' + KA):]}) s""",
)
oracle(
    "report_replicas", "replication_clients",
    f"""select {owned([*_K, 'ord'])}, {blanks(['application_name', 'state', 'sync_state'])}, {zeros(['backend_start', 'backend_xmin'])},
               coalesce(sync_priority, 0) as sync_priority from clients""",
    CLIENTS,
)
_blocks = [f"{kind}_{what}" for kind in ("shared", "local") for what in ("blks_hit", "blks_read", "blks_dirtied", "blks_written")] + ["temp_blks_read", "temp_blks_written"]
_times = {"total_time": "time", "mean_time": "mean_time", "min_time": "min_time", "max_time": "max_time", "blk_read_time": "block_read_time",
          "blk_write_time": "block_write_time", "total_blk_io_time": "block_total_time"}
oracle(
    "report_statements", _stmt_fix + " log_payloads servers plan_events",
    f"""select config_name as of_config_name, {blanks(['database', 'fingerprint', 'query', 'comment', 'explain'])},
               {zeros(['query_id', 'calls', 'rows', 'measured_at'])},
               {', '.join(f'nullif({up(a, 2)}, 0) as {b}' for a, b in _times.items())},
               {', '.join(f'nullif({b}, 0) as {b.replace("_blks_", "_blocks_")}' for b in _blocks)}
        from (select * from valid union all by name select * from explained)""",
    SCAN, TEXT, DELTA, VALID, *_log, SLOWQ, PLAN_TEXT, throttled("plan_keys", _plan_keys), PLANNED,
)
ORACLES["report_statements"] = ORACLES["report_statements"].replace("WITH ", "WITH RECURSIVE ", 1)
oracle("report_tables", _t_fix, f"select {owned([*_K, 'schema'])}, name, {zeros(_fields)} from tdelta", *_t_ctes)
oracle(
    "report_indexes", _i_fix,
    f"""select {owned([*_K, 'schema', 'table_name'])}, name, "unique", unused, valid, nullif(definition, '') as definition,
               {zeros(['bytes', 'bytes_total', 'bloat_bytes', 'bloat_bytes_total', 'bloat_factor', 'scans', 'blocks_read', 'blocks_hit'])} from idelta""",
    *_i_ctes,
)
oracle(
    "report_errors", "errors",
    f"""select seq, {blanks(['error', 'stack_trace'])}, case when panic then true end as panic
        from ({ORACLES['error_cap'][ORACLES['error_cap'].rindex('select seq'):]}) e""",
)
oracle(
    "stream_report_window", "",
    """with timed as (select event_id, event_type, cast(floor(epoch(ts)) as bigint) as secs from events),
       span as (select min(secs) as lo, (max(secs) - min(secs)) // 4 + 1 as step from timed),
       filed as (select t.*, case when event_id % 50 = 0 then 3 else (secs - lo) // step end as file from timed t, span),
       seen as (select file, max(max(secs)) over (order by file rows between unbounded preceding and 1 preceding) as latest from filed group by file)
       select f.secs // 60 * 60 as report_start, event_type,
              count(*) filter (where latest is null or f.secs // 60 * 60 >= (latest - 600) // 60 * 60) as n,
              count(*) filter (where f.secs // 60 * 60 < (latest - 600) // 60 * 60) as n_behind
       from filed f join seen using (file) group by 1, 2""",
)
_content = ORACLES["servers_enriched"]
_content = _content[: _content.rindex("\nselect m.poll_seq")]
_place = "'collector_' || string_split({c}, '_')[-1] as collector_id, {t} // 60 * 60 as report_start"
ORACLES["fleet_report_content"] = _content + f""", folded AS (
  select distinct {_place.format(c='config_name', t='measured_at')}, config_name, config_var_name from meta
), parts AS (
  select config_name, measured_at as at, 'setting' as kind, name, concat_ws('|', nullif(setting, ''), nullif(unit, ''), nullif(source, ''), nullif(boot_val, '')) as value from settings
  union all
  select config_name, measured_at, 'replica', nullif(application_name, ''), concat_ws('|', nullif(state, ''), nullif(sync_state, ''), coalesce(sync_priority, 0)) from clients
  union all
  select config_name, case when measured_at = 0 then max(measured_at) over (partition by {K}) else measured_at end,
         'statement', nullif(fingerprint, ''), concat_ws('|', nullif(calls, 0), nullif(rows, 0)) from tops
  union all
  select config_name, {AT.format(d='day(received_at)')}, 'statement', nullif(fingerprint, ''), concat_ws('|', nullif(calls, 0), explain)
  from explained join (select payload_id, received_at from log_payloads) using (payload_id)
)
select f.collector_id, f.report_start, f.config_name, p.kind, p.name, p.value
from folded f join parts p on p.config_name = f.config_name and p.at // 60 * 60 = f.report_start"""
