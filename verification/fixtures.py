"""Telemetry-shaped inputs derived from the given tables.

Each fixture is one SELECT, written once for both engines; a ``Dialect``
supplies the few spellings that differ.  Spark reads the parquet files directly,
the checking engine reads the registered views of the same files.

The fleet grows with the data: a server is a letter plus a shard of 15 000
orders (10 000 events), so tenfold data gives tenfold servers of constant size.
Times are integers over a power of two, hence exact in any summation order.
"""

from __future__ import annotations

from collections.abc import Container, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.workspace import ensure_shared, land, workspace

K = "config_name, config_var_name, database, poll_seq, measured_at"


class Dialect:
    """Spellings of the checking engine."""

    def table(self, name: str) -> str:
        return name

    def idiv(self, a: str, b: int) -> str:
        return f"({a} // {b})"

    def epoch(self, ts: str) -> str:
        return f"cast(floor(epoch({ts})) as bigint)"

    def hex(self, n: str) -> str:
        return f"hex({n})"

    def json_k(self, col: str) -> str:
        return f"cast(json_extract_string({col}, 'k') as bigint)"

    def array(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def join_lines(self, value: str, order: str) -> str:
        return f"string_agg({value}, chr(10) order by {order})"

    def rfc3339(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

    def ts(self, epoch: str) -> str:
        return f"make_timestamp(({epoch}) * 1000000)"

    def nl(self) -> str:
        return "chr(10)"


class SparkDialect(Dialect):
    """Spellings of Spark SQL, reading ``<sf_dir>/<table>.parquet``."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def idiv(self, a: str, b: int) -> str:
        return f"({a} div {b})"

    def epoch(self, ts: str) -> str:
        return f"unix_seconds(cast({ts} as timestamp))"

    def json_k(self, col: str) -> str:
        return f"cast(get_json_object({col}, '$.k') as bigint)"

    def array(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def join_lines(self, value: str, order: str) -> str:
        return (
            f"array_join(transform(sort_array(collect_list(struct({order} as o, {value} as v))), "
            "x -> x.v), chr(10))"
        )

    def rfc3339(self, ts: str) -> str:
        return f"date_format(cast({ts} as timestamp), \"yyyy-MM-dd'T'HH:mm:ss\") || '+00:00'"

    def ts(self, epoch: str) -> str:
        return f"timestamp_seconds({epoch})"


def _server(extra: str = "") -> str:
    return (
        "letter || '_' || cast(shard as string) as config_name, "
        "letter || '_' || cast(shard as string) || '_URL' as config_var_name, "
        "'db_' || lower(letter) || cast(shard as string) as database, "
        "cast(poll_seq as bigint) as poll_seq, "
        "cast(1700000000 + 60 * poll_seq as bigint) as measured_at"
    )


def _quarter(ts: str) -> str:
    return f"cast((year({ts}) - 1995) * 4 + quarter({ts}) as bigint)"


def _running(column: str, keys: str, alias: str | None = None) -> str:
    return (
        f"cast(sum({column}) over (partition by letter, shard, {keys} order by poll_seq "
        f"rows between unbounded preceding and current row) as bigint) as {alias or column}"
    )


# ---- per-poll cells (one aggregation of a given table each) -----------------


def cells_statement(d: Dialect) -> str:
    return f"""
    select l_returnflag as letter, {d.idiv('l_orderkey', 15000)} as shard, l_partkey % 400 as query_id,
           {_quarter('l_shipdate')} as poll_seq, count(*) as n,
           cast(sum(cast(l_quantity as bigint)) as bigint) as qty,
           cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents,
           cast(min(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents_min,
           cast(max(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents_max,
           cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as disc,
           cast(sum(cast(round(l_tax * 100) as bigint)) as bigint) as tax,
           cast(sum(l_suppkey % 7) as bigint) as s7, cast(sum(l_suppkey % 5) as bigint) as s5
    from {d.table('lineitem')} group by 1, 2, 3, 4"""


def cells_index(d: Dialect) -> str:
    return f"""
    select l_returnflag as letter, {d.idiv('l_orderkey', 15000)} as shard, l_suppkey % 100 as idx,
           {_quarter('l_shipdate')} as poll_seq, count(*) as n,
           cast(sum(cast(l_quantity as bigint)) as bigint) as qty,
           cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents
    from {d.table('lineitem')} group by 1, 2, 3, 4"""


def cells_table(d: Dialect) -> str:
    # A table misses some polls: what fell into one of them is seen by the next.
    quarter = _quarter("o_orderdate")
    return f"""
    select case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as letter,
           {d.idiv('o_orderkey', 15000)} as shard, o_custkey % 25 as tbl,
           {quarter} + case when ((o_custkey % 25) * 7 + {quarter}) % 31 = 0 then 1 else 0 end as poll_seq, count(*) as n,
           cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents,
           cast(sum(o_custkey % 11) as bigint) as c11, max(o_orderkey) as last_order,
           {d.epoch('max(o_orderdate)')} as last_at
    from {d.table('orders')} group by 1, 2, 3, 4"""


def cells_event(d: Dialect) -> str:
    return f"""
    select substr('ANR', cast(user_id % 3 as int) + 1, 1) as letter, {d.idiv('event_id', 10000)} as shard,
           cast(day(ts) as bigint) as poll_seq, count(*) as n,
           cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents,
           cast(sum({d.json_k('props')}) as bigint) as k,
           cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as n_view,
           cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as n_click,
           cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as n_purchase,
           cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_error
    from {d.table('events')} group by 1, 2, 3"""


# ---- statements --------------------------------------------------------------


def statements_raw(d: Dialect) -> str:
    """Statement counters with raw text; some ids twice per poll, some reset, some foreign."""
    keys = "query_id, epoch"
    w = (
        "over (partition by letter, shard, query_id, epoch order by poll_seq "
        "rows between unbounded preceding and current row)"
    )
    run = {
        c: f"cast(sum({c}) {w} as bigint)" for c in ("n", "qty", "cents", "disc", "tax", "s7", "s5")
    }
    del keys
    return f"""
    select {_server()}, query_id * 2 + copy as ord, query_id,
           case when query_id % 29 = 0 then cast(16385 as bigint) else cast(16384 as bigint) end as dbid,
           case when query_id % 97 = 0 then null
                else 'SELECT * FROM t_' || cast(query_id % 300 as string) || ' WHERE id = ' || cast(query_id as string)
                  || ' AND name = ''widget ' || cast(query_id % 7 as string) || '''  LIMIT 10'
                  || case when query_id % 41 = 5 then ' OFFSET 5 -- from 10.0.0.' || cast(query_id % 256 as string) else '' end
                  || case when query_id % 50 = 7 then ' /* app:fleet-collector */' else ' /*app:' || letter || '*/' end
           end as query,
           calls + copy as calls,
           cents * (1 + copy) / 524288.0e0 as total_exec_time, cents_min / 524288.0e0 as min_exec_time,
           cents_max / 524288.0e0 as max_exec_time,
           cents * (2 + copy) / 524288.0e0 as total_time, cents_min / 262144.0e0 as min_time,
           cents_max / 262144.0e0 as max_time,
           qty as "rows", s7 as shared_blks_hit, s5 as shared_blks_read, calls * 2 as shared_blks_dirtied,
           s7 + s5 as shared_blks_written, s7 * 2 as local_blks_hit, s5 * 2 as local_blks_read,
           calls * 3 as local_blks_dirtied, s5 + 1 as local_blks_written, s7 + 2 as temp_blks_read, s5 + 3 as temp_blks_written,
           disc / 4.0e0 as blk_read_time, tax / 4.0e0 as blk_write_time
    from (
      select letter, shard, query_id, poll_seq, {run['n']} as calls, {run['qty']} as qty, {run['cents']} as cents,
             min(cents_min) {w} as cents_min, max(cents_max) {w} as cents_max,
             {run['disc']} as disc, {run['tax']} as tax, {run['s7']} as s7, {run['s5']} as s5
      from (select *, case when query_id % 37 = 0 and poll_seq >= 8 then 1 else 0 end as epoch
            from cells_statement) e) r
    join (select cast(0 as bigint) as copy union all select cast(1 as bigint) as copy) c
      on c.copy = 0 or r.query_id % 53 = 3""".replace('"rows"', _q(d, "rows"))


def _q(d: Dialect, name: str) -> str:
    return f"`{name}`" if isinstance(d, SparkDialect) else f'"{name}"'


def pg_database(d: Dialect) -> str:
    return f"""
    select {K}, cast(16384 as bigint) as oid, database as datname from polls_statement
    union all
    select {K}, cast(16385 as bigint) as oid, 'postgres' as datname from polls_statement"""


def polls_statement(d: Dialect) -> str:
    return f"select distinct {_server()} from cells_statement"


def server_versions(d: Dialect) -> str:
    return """
    select distinct config_name, config_var_name, database,
           case substr(config_name, 1, 1) when 'A' then '14.5' when 'N' then '12.9' else '9.6.24' end as version
    from polls_statement"""


# ---- catalog -----------------------------------------------------------------


def _schema_name(n: str) -> str:
    names = {
        0: "public", 1: "sales", 2: "pg_catalog", 3: "pg_toast_temp_1",
        4: "heroku_ext", 5: "pgxtemp_7", 6: "app", 7: "information_schema",
    }
    return f"case {n} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + " end"


def polls_table(d: Dialect) -> str:
    return f"select distinct {_server()} from cells_table"


def schemata(d: Dialect) -> str:
    return f"""
    select distinct {_server()}, {_schema_name("(case when letter <> 'A' and tbl % 8 = 4 then 5 else tbl % 8 end)")} as schema_name
    from cells_table"""


def pg_namespace(d: Dialect) -> str:
    return f"""
    select distinct {_server()}, 100 + tbl % 8 as oid, {_schema_name('tbl % 8')} as nspname
    from cells_table"""


def table_rows(d: Dialect) -> str:
    run = [("n", "n"), ("cents", "cents"), ("c11", "c11")]
    return f"""
    select letter, shard, tbl, poll_seq, last_at, last_order,
           {', '.join(_running(c, 'tbl', 'r_' + a) for c, a in run)}
    from cells_table"""


def index_rows(d: Dialect) -> str:
    run = [("n", "n"), ("cents", "cents"), ("qty", "qty")]
    return f"""
    select letter, shard, idx, poll_seq,
           {', '.join(_running(c, 'idx', 'r_' + a) for c, a in run)}
    from cells_index"""


def pg_class(d: Dialect) -> str:
    return f"""
    select {_server()}, 1000 + tbl as oid, 'table_' || cast(tbl as string) as relname,
           case when tbl = 23 then cast(999 as bigint) else 100 + tbl % 8 end as relnamespace,
           case when tbl = 22 then 'v' else 'r' end as relkind,
           {d.idiv('r_n * (tbl % 5)', 2)} as relpages, cast(r_n * 16 as double) as reltuples,
           case when tbl = 21 then null else r_n * 8192 end as total_bytes, r_n * 1024 as index_bytes,
           case when tbl % 3 = 0 then null else r_c11 * 16 end as toast_bytes
    from table_rows
    union all
    select {_server()}, 5000 + idx as oid, 'idx_' || cast(idx % 90 as string) as relname,
           100 + (idx % 25) % 8 as relnamespace, 'i' as relkind,
           {d.idiv('r_n * (idx % 4)', 3)} as relpages, cast(r_n * 32 as double) as reltuples,
           r_qty * 64 as total_bytes, cast(0 as bigint) as index_bytes, cast(null as bigint) as toast_bytes
    from index_rows"""


def pg_index(d: Dialect) -> str:
    return f"""
    select {_server()}, 5000 + idx as indexrelid, 1000 + idx % 25 as indrelid,
           idx % 5 = 0 as indisunique, idx % 11 <> 0 as indisvalid,
           {d.array('idx % 4', 'idx % 3 + 1')} as indkey
    from index_rows"""


def index_stat(d: Dialect) -> str:
    return f"""
    select {_server()}, 5000 + idx as indexrelid, {_schema_name('(idx % 25) % 8')} as schemaname,
           'table_' || cast(idx % 25 as string) as relname, 'idx_' || cast(idx % 90 as string) as indexrelname,
           case when idx % 3 = 1 then cast(0 as bigint) else r_n end as idx_scan
    from index_rows"""


def index_statio(d: Dialect) -> str:
    return f"""
    select {_server()}, 5000 + idx as indexrelid, r_n as idx_blks_read,
           case when idx % 10 = 9 then null else r_qty end as idx_blks_hit
    from index_rows"""


def pg_indexes(d: Dialect) -> str:
    return f"""
    select {_server()}, {_schema_name('(idx % 25) % 8')} as schemaname, 'idx_' || cast(idx % 90 as string) as indexname,
           'CREATE INDEX idx_' || cast(idx as string) || ' ON table_' || cast(idx % 25 as string) as indexdef
    from index_rows"""


def pg_constraint(d: Dialect) -> str:
    return f"select {_server()}, 5000 + idx as conindid from index_rows where idx % 7 = 0"


def pg_stats(d: Dialect) -> str:
    return f"""
    select {_server()}, {_schema_name('(idx % 25) % 8')} as schemaname, 'table_' || cast(idx % 25 as string) as tablename,
           'col_' || cast(idx as string) as attname, (idx % 5) / 8.0e0 as null_frac,
           cast(idx % 40 + 1 as int) as avg_width
    from index_rows"""


def columns(d: Dialect) -> str:
    return f"""
    select {_server()}, {_schema_name('(idx % 25) % 8')} as table_schema, 'table_' || cast(idx % 25 as string) as table_name,
           'col_' || cast(idx as string) as column_name,
           case when idx % 4 = 0 then null else 'd' || cast(idx as string) end as column_default,
           case idx % 3 when 0 then 'YES' when 1 then 'NO' else null end as is_nullable,
           case when idx % 2 = 0 then 'numeric' else 'integer' end as data_type,
           case when idx % 6 = 0 then idx else null end as character_maximum_length,
           idx % 20 as numeric_precision, idx % 5 as numeric_scale,
           case when idx % 9 = 0 then 'DAY' else null end as interval_type,
           case when idx % 8 = 0 then 'YES' else 'NO' end as is_identity
    from index_rows"""


def table_stat(d: Dialect) -> str:
    return f"""
    select {_server()}, 1000 + tbl as relid, {_schema_name('tbl % 8')} as schemaname, 'table_' || cast(tbl as string) as relname,
           r_n as seq_scan, r_n * 10 as seq_tup_read,
           case when tbl % 9 = 4 then null else r_c11 end as idx_scan,
           case when tbl % 9 = 4 then null else r_c11 * 3 end as idx_tup_fetch,
           r_n + 1 as n_tup_ins, r_c11 + 1 as n_tup_upd, r_n * 2 as n_tup_del,
           last_order % 1000 as n_live_tup, last_order % 100 as n_dead_tup, last_order % 50 as n_mod_since_analyze,
           {d.ts('last_at')} as last_vacuum,
           case when tbl % 2 = 0 then null else {d.ts('last_at + 60')} end as last_autovacuum,
           {d.ts('last_at + 3600')} as last_analyze,
           case when tbl % 5 = 0 then {d.ts('last_at + 86400')} else null end as last_autoanalyze,
           r_n + 2 as vacuum_count, r_c11 + 2 as autovacuum_count, r_n + 3 as analyze_count, r_c11 + 3 as autoanalyze_count
    from table_rows"""


def table_statio(d: Dialect) -> str:
    return f"""
    select {_server()}, 1000 + tbl as relid,
           r_n * 3 as heap_blks_read, r_c11 * 5 as heap_blks_hit, r_n + 4 as idx_blks_read, r_c11 + 4 as idx_blks_hit,
           case when tbl % 4 = 0 then null else r_n + 5 end as toast_blks_read,
           case when tbl % 4 = 0 then null else r_c11 + 5 end as toast_blks_hit,
           case when tbl % 4 = 1 then null else r_n + 6 end as tidx_blks_read,
           case when tbl % 4 = 1 then null else r_c11 + 6 end as tidx_blks_hit
    from table_rows"""


def settings(d: Dialect) -> str:
    return f"""
    select {_server()}, tbl as ord,
           case tbl when 0 then 'superuser_reserved_connections' when 1 then 'max_connections'
                    when 2 then 'server_version' else 'setting_' || cast(tbl as string) end as name,
           case when tbl = 2 then cast(9 + shard % 6 as string) || '.' || cast(poll_seq as string) || ' (Ubuntu build)'
                else cast(n as string) end as setting,
           case when tbl % 3 = 0 then null else 'kB' end as unit, 'Category ' || cast(tbl % 4 as string) as category,
           'Sets value ' || cast(tbl as string) || '.' as short_desc,
           case when tbl % 2 = 0 then null else 'More about it.' end as extra_desc,
           'user' as context, case when tbl % 2 = 0 then 'integer' else 'string' end as vartype,
           'default' as source, case when tbl % 4 = 0 then '0' else null end as min_val,
           case when tbl % 4 = 0 then '100' else null end as max_val, cast(null as string) as enumvals,
           case when tbl % 5 = 0 then '' else cast(tbl as string) end as boot_val, cast(n as string) as reset_val,
           c11 % 2 = 0 as pending_restart
    from cells_table"""


def activity(d: Dialect) -> str:
    """One row per backend and poll; the walreceiver is there in some polls."""
    return f"""
    select {_server()}, o_orderkey as pid,
           case when o_orderkey % 97 = 0 then 'walreceiver' else 'client backend' end as backend_type,
           cast(o_orderdate as timestamp) as backend_start
    from (select o_orderkey, o_orderdate,
                 case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as letter,
                 {d.idiv('o_orderkey', 15000)} as shard, {_quarter('o_orderdate')} as poll_seq
          from {d.table('orders')}) o"""


def config_vars(d: Dialect) -> str:
    return f"""
    select c_custkey as var_id,
           case when c_custkey % 3 = 0 then 'HEROKU_POSTGRESQL_' else '' end || c_mktsegment || '_'
             || cast(c_custkey as string) || case when c_custkey % 5 = 0 then '_DSN' else '_URL' end as name,
           case when c_custkey % 7 = 0 then 'https://' else 'postgres://' end
             || case when c_custkey % 11 = 0 then '' else 'user' || cast(c_nationkey as string) || ':pw@' end
             || 'host-' || cast(c_custkey as string) || '.example.com'
             || case when c_custkey % 4 = 0 then '' else ':5432' end || '/db' || cast(c_nationkey as string) as value
    from {d.table('customer')}"""


# ---- database and pooler counters --------------------------------------------


def db_stats(d: Dialect) -> str:
    """Counters of successful polls only; what fell into an absent poll is seen by the next."""
    run = ["n", "cents", "k", "n_view", "n_click", "n_purchase", "n_error"]
    w = "over (partition by letter, shard order by poll_seq rows between unbounded preceding and current row)"
    sums = ", ".join(f"cast(sum({c}) {w} as bigint) as {c}" for c in run)

    def dbl(expr: str, name: str) -> str:
        return f"cast({expr} as double) as {name}"

    cols = [
        dbl("n", "xact_commit"), dbl("n_error", "xact_rollback"), dbl("n_view", "blks_read"),
        dbl("k", "blks_hit"), dbl("k * 2", "tup_returned"), dbl("k + n", "tup_fetched"),
        dbl("n_purchase", "tup_inserted"), dbl("n_click", "tup_updated"), dbl("n_error * 3", "tup_deleted"),
        dbl("n_error + 1", "conflicts"), dbl("n_view * 2", "temp_files"), dbl("cents", "temp_bytes"),
        dbl("n_error * 2", "deadlocks"), "cents / 128.0e0 as blk_read_time", "cents / 1024.0e0 as blk_write_time",
    ]
    return f"""
    select {_server()}, {', '.join(cols)}
    from (select letter, shard, poll_seq, {sums} from (
      select letter, shard, poll_seq + case when (poll_seq + shard) % 6 = 0 then 1 else 0 end as poll_seq,
             {", ".join(f"sum({c}) as {c}" for c in run)}
      from cells_event group by 1, 2, 3) e) r"""


def pooler_totals(d: Dialect) -> str:
    run = ["n", "cents", "k", "n_view", "n_click"]
    w = "over (partition by letter, shard order by poll_seq rows between unbounded preceding and current row)"
    sums = ", ".join(f"cast(sum({c}) {w} as bigint) as {c}" for c in run)
    return f"""
    select {_server()}, ord,
           case when ord = 2 then 'pgbouncer' else 'db_' || lower(letter) || cast(shard as string) end as db,
           cast(n + ord as double) as xact_count, cast(k + ord as double) as query_count,
           cast(cents as double) as bytes_received, cast(cents * 2 as double) as bytes_sent,
           cast(cents * 1000 as double) as xact_time, cast(cents * 500 as double) as query_time,
           cast(n_view * 250 as double) as wait_time
    from (select letter, shard, poll_seq, {sums} from cells_event) r
    join (select cast(0 as bigint) as ord union all select cast(1 as bigint) as ord
          union all select cast(2 as bigint) as ord) o
      on o.ord <> 1 or r.poll_seq % 5 = 0"""


def pooler_pools(d: Dialect) -> str:
    return f"""
    select {_server()}, ord,
           case when ord = 2 then 'pgbouncer' else 'db_' || lower(letter) || cast(shard as string) end as db,
           'user' || cast(ord as string) as {_q(d, 'user')},
           case when letter = 'R' then cast(0 as bigint) else n_view + ord end as cl_active,
           case when letter = 'R' then cast(0 as bigint) else n_click end as cl_waiting,
           case when letter = 'R' then cast(0 as bigint) else n_error end as sv_active,
           n_purchase + ord as sv_idle, cast(0 as bigint) as sv_used, cast(0 as bigint) as sv_tested,
           cast(0 as bigint) as sv_login, k % 10 as maxwait, k as maxwait_us, 'transaction' as pool_mode
    from cells_event
    join (select cast(0 as bigint) as ord union all select cast(1 as bigint) as ord
          union all select cast(2 as bigint) as ord) o
      on o.ord <> 1 or cells_event.poll_seq % 4 = 0"""


def pooler_databases(d: Dialect) -> str:
    return f"""
    select {_server()}, cast(0 as bigint) as ord, 'db_' || lower(letter) || cast(shard as string) as db,
           n % 100 as max_connections from cells_event
    union all
    select {_server()}, cast(1 as bigint) as ord, 'pgbouncer' as db, cast(7 as bigint) as max_connections
    from cells_event"""


def pooler_versions(d: Dialect) -> str:
    return f"""
    select {_server()}, case when shard % 9 = 8 then '' else 'PgBouncer 1.' || cast(15 + shard % 3 as string) || '.0 ' end as version
    from cells_event"""


# ---- replication ---------------------------------------------------------------


def replication_clients(d: Dialect) -> str:
    def lag(name: str, every: int, base: str) -> str:
        full = d.struct(
            months="cast(idx % 2 as int)", days="cast(idx % 3 as int)", micros=f"cast({base} as bigint)"
        )
        return f"case when idx % {every} = 0 then null else {full} end as {name}"

    def lsn(name: str, back: int) -> str:
        low = f"r_cents - {back} * r_n"
        none = f"case when idx % 17 = {back} then null else " if back else ""
        end = " end" if back else ""
        return f"{none}{d.hex('shard + 1')} || '/' || {d.hex(low)}{end} as {name}"

    return f"""
    select {_server()}, idx as ord,
           case when idx % 10 = 9 then null else 'standby_' || cast(idx as string) end as application_name,
           '10.1.2.' || cast(idx as string) as client_addr, 'h' || cast(idx as string) as client_hostname,
           cast(5432 as int) as client_port,
           case when idx % 6 = 5 then null else {d.ts('1600000000 + r_n * 86400')} end as backend_start,
           case when idx % 2 = 0 then null else r_n end as backend_xmin,
           case when idx % 4 = 0 then null else 'streaming' end as state,
           {lag('write_lag', 3, 'r_qty * 777')}, {lag('flush_lag', 4, 'r_qty * 1234')},
           {lag('replay_lag', 5, '0 - r_qty * 555')},
           {lsn('sent_lsn', 0)}, {lsn('write_lsn', 1)}, {lsn('flush_lsn', 2)}, {lsn('replay_lsn', 3)},
           case when idx % 3 = 0 then null else cast(idx % 2 as int) end as sync_priority,
           case when idx % 3 = 0 then null else 'async' end as sync_state
    from index_rows"""


def wal_receiver(d: Dialect) -> str:
    lag = d.struct(months="cast(0 as int)", days="cast(c11 % 3 as int)", micros="cast(cents as bigint)")
    return f"""
    select {_server()}, case when c11 % 2 = 0 then 'streaming' else 'waiting' end as status,
           case when poll_seq % 5 = 0 then ''
                when poll_seq % 7 = 0 then 'user=postgres dbname=replication'
                else 'user=postgres host=host-' || cast(shard % 40 as string) || '.example.com port=5432 application_name=follower'
                  || cast(c11 as string) || ' sslmode=prefer' end as conninfo,
           case when poll_seq % 3 = 0 then null else {lag} end as lag
    from (select letter, shard, poll_seq, cast(sum(c11) as bigint) as c11, cast(sum(cents) as bigint) as cents
          from cells_table group by 1, 2, 3) c"""


def known_servers(d: Dialect) -> str:
    """Hosts of known servers; two servers share each host."""
    return f"""
    select distinct letter || '_' || cast(shard as string) as config_name,
           'host-' || cast(shard % 40 as string) || '.example.com' as host,
           shard * 3 + case letter when 'A' then 2 when 'N' then 1 else 0 end as ord
    from cells_table"""


# ---- logs ------------------------------------------------------------------------


def log_payloads(d: Dialect) -> str:
    at = (
        f"case when event_id % 101 = 7 then 'not-a-time' else {d.rfc3339('ts')} end"
    )
    color = (
        "substr('ANR', cast(user_id % 3 as int) + 1, 1) || '_' || cast("
        + d.idiv("event_id", 10000)
        + " as string)"
    )
    pid = "cast(user_id as string)"
    seg = "cast(event_id % 50 as string)"
    meta = "' sql_error_code = 00000 time_ms = \"x\" pid=\"' || cast(user_id as string) || '\" LOG:  duration: '"
    dur = f"cast(event_id % 5000 as string) || '.' || cast(100 + {d.json_k('props')} as string) || ' ms  execute <unnamed>: '"
    collector = "case when event_id % 31 = 0 then ' /* app:fleet-collector */' else ' /*app:web,id:' || cast(user_id as string) || '*/' end"
    head = f"'300 <134>1 ' || {at} || ' host app '"
    purchase = (
        f"{head} || 'postgres.' || {pid} || ' - [' || {color} || '] [' || {seg} || '-1] ' || {meta} || {dur}"
        f" || 'SELECT * FROM orders WHERE user_id = ' || {pid} || ' AND kind IN (1, 2, 3) LIMIT 5' || {collector}"
    )
    click = (
        f"{head} || 'postgres.' || {pid} || ' - [' || {color} || '] [' || {seg} || '-1] ' || {meta} || {dur}"
        f" || 'UPDATE clicks SET' || {d.nl()} || {head} || 'postgres.' || {pid} || ' - [' || {color} || '] [' || {seg}"
        f" || '-2]  seen = ''yes'' WHERE id = ' || cast(event_id % 40 as string)"
    )
    view = (
        f"{head} || 'heroku-postgres - source=' || {color} || ' addon=x sample#k=' || cast({d.json_k('props')} as string)"
        " || ' sample#tables sample#user=' || cast(user_id as string) || ' user=u' || cast(user_id % 10 as string) || 'kB'"
    )
    error = (
        f"{head} || 'postgres.' || {pid} || ' - [' || {color} || '] [' || {seg} || '-1] '"
        " || ' sql_error_code = 23505 pid=\"1\" ERROR:  duplicate key value'"
        " || case when event_id % 40 = 1 then ' NOTICE:  FLEET_COLLECTOR_LOG_TEST' else '' end"
    )
    signup = "'300 <134>1 x host router heroku/web.1 - at=info path=/signup/' || cast(user_id as string)"
    return f"""
    select {d.idiv('event_id', 4)} as payload_id, max(cast(ts as timestamp)) as received_at,
           {d.join_lines('line', 'event_id')} as body
    from (select event_id, ts, case event_type when 'purchase' then {purchase} when 'click' then {click}
                 when 'view' then {view} when 'error' then {error} else {signup} end as line
          from {d.table('events')}) l
    group by 1"""


def servers(d: Dialect) -> str:
    """Known servers of the log stream; one letter of every third shard is unknown."""
    return f"""
    select distinct letter || '_' || cast(shard as string) as config_name,
           letter || '_' || cast(shard as string) || '_URL' as config_var_name,
           'db_' || lower(letter) || cast(shard as string) as database,
           shard * 3 + case letter when 'A' then 2 when 'N' then 1 else 0 end as ord
    from cells_event where not (letter = 'R' and shard % 3 = 0)"""


def errors(d: Dialect) -> str:
    return f"""
    select event_id as seq, cast(ts as timestamp) as event_time, 'error ' || cast(user_id as string) as error,
           user_id % 29 = 0 as panic, 'at ' || cast(event_id % 10 as string) as stack_trace
    from {d.table('events')} where event_type = 'error'"""


def explain_events(d: Dialect) -> str:
    return f"""
    select event_id, substr('ANR', cast(user_id % 3 as int) + 1, 1) || '_' || cast({d.idiv('event_id', 10000)} as string) as config_name,
           substr(md5(cast(user_id % 20 as string)), 1, 10) as fingerprint, {d.epoch('ts')} as measured_at,
           case when event_id % 23 = 0 then repeat('x', 30001) else 'SELECT ' || cast(user_id as string) end as raw,
           'Seq Scan on t  (cost=0.00..1.00 rows=' || cast(user_id as string) || ')' || {d.nl()} || '  Filter: ((id = '
             || cast(user_id as string) || ') AND (kind = ''' || event_type || '''::text))' as plan
    from {d.table('events')}"""


def plan_events(d: Dialect) -> str:
    """Plans of the slow statements in the log payloads, taken up to 90 seconds after their line."""
    user = "cast(user_id as string)"
    return f"""
    select event_id as plan_id, substr('ANR', cast(user_id % 3 as int) + 1, 1) || '_' || cast({d.idiv('event_id', 10000)} as string) as config_name,
           {d.epoch('ts')} + event_id % 90 as measured_at,
           case event_type when 'purchase' then 'SELECT * FROM orders WHERE user_id = ' || {user} || ' AND kind IN (1, 2, 3) LIMIT 5'
                else 'UPDATE clicks SET seen = ''yes'' WHERE id = ' || cast(event_id % 40 as string) end
             || case when event_id % 31 = 0 then ' /* app:fleet-collector */' else '' end
             || case when event_id % 97 = 0 then repeat(' ', 30001) else '' end as raw,
           'Update on t  (cost=0.00..1.00 rows=' || {user} || ')' || {d.nl()} || '  Index Cond: (id = ' || {user} || ')' as plan
    from {d.table('events')} where event_type in ('purchase', 'click')"""


def metrics_long(d: Dialect) -> str:
    return f"""
    select {_server()}, event_id as ord, event_type || '.value' as name,
           case when event_id % 4 = 0 then '' else 'entity/' || cast(event_id % 4 as string) end as entity,
           value / 3.0e0 as value
    from (select *, substr('ANR', cast(user_id % 3 as int) + 1, 1) as letter, {d.idiv('event_id', 10000)} as shard,
                 cast(day(ts) as bigint) as poll_seq from {d.table('events')}) e"""


# ---- folding -----------------------------------------------------------------------


def server_records(d: Dialect) -> str:
    pooler = d.struct(max_server_connections="n", version="'1.' || cast(tbl as string)")
    return f"""
    select {_server()}, poll_seq * 100 + tbl as ord,
           case when c11 % 3 = 0 then '' else '14.' || cast(c11 % 9 as string) end as version,
           case when tbl % 2 = 0 then 'heroku' else 'unknown' end as platform,
           case when c11 % 4 = 0 then cast(0 as bigint) else n * 10 end as max_connections,
           case when tbl % 3 = 0 then null else {pooler} end as pooler,
           {d.epoch('cast(' + d.ts('last_at') + ' as timestamp)')} + tbl as monitored_at
    from cells_table"""


# ---- text corpus ---------------------------------------------------------------------


def corpus(d: Dialect) -> str:
    """SQL statements built from every line item plus all documents and conversations."""
    return f"""
    select 'l' || cast(l_orderkey as string) || '.' || cast(l_linenumber as string) || '.' || cast(l_partkey as string)
             || '.' || cast(l_suppkey as string) || '.' || cast(cast(l_quantity as bigint) as string) as row_key,
           case l_linenumber
             when 1 then 'SELECT * FROM lines WHERE part = ' || cast(l_partkey as string) || ' and qty>' || cast(l_quantity as string) || '  LIMIT 10'
             when 2 then 'INSERT INTO lines (a, b) VALUES (' || cast(l_orderkey as string) || ', ''' || l_returnflag || '''), (2, ''x'') RETURNING id /*app:' || l_linestatus || '*/'
             when 3 then '/* lead */ select $1 from t where k in (' || cast(l_partkey as string) || ',' || cast(l_suppkey as string) || ') and note ilike ''%a b%''/* tail */'
             when 4 then 'SELECT 1 WHERE d BETWEEN ''1998-01-01'' AND ''1999-01-01'' and x between symmetric ' || cast(l_suppkey as string) || '  and $2' || chr(10) || 'offset 5'
             when 5 then 'UPDATE t SET ip = ''10.20.30.' || cast(l_suppkey % 256 as string) || ''' WHERE host = 192.168.0.1 /* app:fleet-collector */'
             when 6 then 'select case when a = 1 then ''yes'' end ' || chr(9) || ' from t where z <> 3.50 or y like $3'
             else 'VACUUM lines' end as text
    from {d.table('lineitem')}
    union all
    select 'd' || cast(doc_id as string) as row_key, text from {d.table('documents')}
    union all
    select 'c' || cast(conv_id as string) || '.' || cast(turn as string) as row_key, text from {d.table('conversations')}"""


def versions(d: Dialect) -> str:
    return f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
           case when l_suppkey % 13 = 0 then '' when l_suppkey % 17 = 0 then 'x' || cast(l_partkey as string)
                when l_linenumber % 2 = 0 then cast(l_partkey % 16 as string) || '.' || cast(l_suppkey % 12 as string)
                else cast(l_partkey % 16 as string) || '.' || cast(l_linenumber as string) || '.' || cast(l_suppkey % 30 as string) end as left_version,
           case when l_orderkey % 19 = 0 then 'v1..2' else cast(l_orderkey % 15 as string) || '.' || cast(l_linenumber % 3 as string) end as right_version
    from {d.table('lineitem')}"""


def conninfos(d: Dialect) -> str:
    return f"""
    select c_custkey, 'user=postgres' || case when c_custkey % 3 = 0 then '' else ' host=' || replace(c_name, '#', '-') || '.example.com' end
             || ' port=5432' || case when c_custkey % 4 = 0 then ' application_name=a=b' else ' application_name=f' || cast(c_nationkey as string) end
             || case when c_custkey % 5 = 0 then ' host=last-' || cast(c_nationkey as string) else '' end as conninfo
    from {d.table('customer')}"""


FIXTURES: dict[str, tuple[tuple[str, ...], object]] = {
    "cells_statement": ((), cells_statement),
    "cells_index": ((), cells_index),
    "cells_table": ((), cells_table),
    "cells_event": ((), cells_event),
    "statements_raw": (("cells_statement",), statements_raw),
    "polls_statement": (("cells_statement",), polls_statement),
    "pg_database": (("polls_statement",), pg_database),
    "server_versions": (("polls_statement",), server_versions),
    "polls_table": (("cells_table",), polls_table),
    "schemata": (("cells_table",), schemata),
    "pg_namespace": (("cells_table",), pg_namespace),
    "table_rows": (("cells_table",), table_rows),
    "index_rows": (("cells_index",), index_rows),
    "pg_class": (("table_rows", "index_rows"), pg_class),
    "pg_index": (("index_rows",), pg_index),
    "index_stat": (("index_rows",), index_stat),
    "index_statio": (("index_rows",), index_statio),
    "pg_indexes": (("index_rows",), pg_indexes),
    "pg_constraint": (("index_rows",), pg_constraint),
    "pg_stats": (("index_rows",), pg_stats),
    "columns": (("index_rows",), columns),
    "table_stat": (("table_rows",), table_stat),
    "table_statio": (("table_rows",), table_statio),
    "settings": (("cells_table",), settings),
    "activity": ((), activity),
    "config_vars": ((), config_vars),
    "db_stats": (("cells_event",), db_stats),
    "pooler_totals": (("cells_event",), pooler_totals),
    "pooler_pools": (("cells_event",), pooler_pools),
    "pooler_databases": (("cells_event",), pooler_databases),
    "pooler_versions": (("cells_event",), pooler_versions),
    "replication_clients": (("index_rows",), replication_clients),
    "wal_receiver": (("cells_table",), wal_receiver),
    "known_servers": (("cells_table",), known_servers),
    "log_payloads": ((), log_payloads),
    "servers": (("cells_event",), servers),
    "errors": ((), errors),
    "explain_events": ((), explain_events),
    "plan_events": ((), plan_events),
    "metrics_long": ((), metrics_long),
    "server_records": (("cells_table",), server_records),
    "corpus": ((), corpus),
    "versions": ((), versions),
    "conninfos": ((), conninfos),
}


#: Written down once a query: most other fixtures are read off them, and each reader would derive them anew.
SHARED = ("cells_statement", "polls_statement", "cells_table", "cells_event", "table_rows", "index_rows", "log_payloads")


def _closure(names: tuple[str, ...], known: Container[str] = ()) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in () if name in known else FIXTURES[name][0]:
            visit(dep)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def ctes(d: Dialect, *names: str, written: Mapping[str, str] = {}) -> str:
    """``name AS (...), ...`` for the fixtures and everything they are built from; ``written`` ones are read."""

    def body(name: str) -> str:
        return f"SELECT * FROM parquet.`{written[name]}`" if name in written else FIXTURES[name][1](d)

    return ",\n".join(f"{n} AS ({body(n)})" for n in _closure(names, written))


_WRITTEN: list[dict[str, str]] = []


@contextmanager
def derived_once() -> Iterator[None]:
    """Inside, each of the ``SHARED`` fixtures is derived once and read from the shared folder by all others."""
    _WRITTEN.append({})
    try:
        yield
    finally:
        _WRITTEN.pop()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture as a DataFrame."""
    written = _WRITTEN[-1] if _WRITTEN else {}

    def frame(name: str) -> DataFrame:
        return spark.sql(f"WITH {ctes(SparkDialect(sf_dir), name, written=written)} SELECT * FROM {name}")

    for shared in _closure((name,)) if _WRITTEN else ():
        if shared in SHARED and shared not in written:
            ensure_shared(spark)
            path = workspace(spark, f"fixture-{shared}")
            land(frame(shared), path)
            written[shared] = path
    return frame(name)
