import datetime as dt
import random

import pytest

from fleetlens.operators import logs
from fleetlens.operators import querystats as qs
from fleetlens.sources.tables import read_log_payloads, read_snapshot, stream_log_payloads
from fleetlens.sources.workspace import workspace
from fleetlens.streaming.run import drain, each_batch, windowed_counts
from fleetlens.streaming.state import ROCKSDB, stream_attach_plans, stream_counter_delta, stream_explain_throttle


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State of small streams in two partitions: each costs a Python worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _in_batches(spark, parts, schema):
    """A stream that reads one part a micro-batch."""
    path = workspace(spark, "test") + "/in"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


POLLS = "k string, poll_seq bigint, ord bigint, measured_at bigint, n bigint"
LATER = [("z", 1, 0, 10_000, 0)]


def _deltas(rows):
    return sorted((r.k, r.poll_seq, r.n) for r in rows if not r.behind)


def test_counter_delta_over_several_batches_equals_one(spark):
    data = [[("a", 1, 0, 60, 10), ("b", 1, 0, 60, 1)], [("a", 2, 0, 120, 15)], [("a", 3, 0, 180, 40), ("b", 3, 0, 180, 9)], LATER]
    stream = _in_batches(spark, data, POLLS)
    adjacent = drain(spark, stream_counter_delta(stream, ["k"], ["n"], "1 minute"), "t1").collect()
    assert _deltas(adjacent) == [("a", 2, 5), ("a", 3, 25)]
    lagged = drain(spark, stream_counter_delta(stream, ["k"], ["n"], "1 minute", adjacent=False), "t2").collect()
    assert _deltas(lagged) == [("a", 2, 5), ("a", 3, 25), ("b", 3, 8)]


def test_counter_delta_of_shuffled_files(spark):
    """Polls 1, 3, 2 in three files, one poll in two files, and a null counter."""
    data = [[("a", 1, 0, 60, 10)], [("a", 3, 0, 180, 40), ("b", 1, 0, 60, None)], [("a", 2, 0, 120, 15), ("b", 2, 1, 120, 5)],
            [("b", 2, 0, 120, 7), ("b", 3, 0, 180, 8)], LATER]
    got = drain(spark, stream_counter_delta(_in_batches(spark, data, POLLS), ["k"], ["n"], "5 minutes"), "t3").collect()
    assert _deltas(r for r in got if r.k == "a") == [("a", 2, 5), ("a", 3, 25)]
    # Every row of the earlier poll pairs with the first row of the next.
    assert sorted((r.poll_seq, r.ord, r.n) for r in got if r.k == "b") == [(2, 0, None), (3, 0, 1), (3, 1, 3)]
    assert not any(r.behind for r in got)


def test_polls_behind_the_watermark_come_out_marked(spark):
    data = [[("a", 1, 0, 60, 10)], [("a", 3, 0, 5000, 40)], LATER, [("z", 2, 0, 11_000, 0)], [("a", 2, 0, 120, 15)], [("z", 3, 0, 20_000, 0)]]
    got = drain(spark, stream_counter_delta(_in_batches(spark, data, POLLS), ["k"], ["n"], "1 minute"), "t4").collect()
    assert [(r.k, r.poll_seq, r.n, r.behind) for r in got if r.k == "a"] == [("a", 2, 15, True)]


def test_a_key_not_seen_for_long_is_forgotten(spark):
    data = [[("a", 1, 0, 60, 10)], [("z", 1, 0, 500, 0)], [("z", 2, 0, 9000, 0)], [("z", 3, 0, 9010, 0)], [("a", 2, 0, 9060, 15)], [("z", 4, 0, 99_000, 0)]]
    stream = _in_batches(spark, data, POLLS)
    assert _deltas(drain(spark, stream_counter_delta(stream, ["k"], ["n"], "1 minute", forget=100), "t5").collect()) == [("z", 2, 0), ("z", 3, 0)]


FLEET = "config_name string, config_var_name string, database string, query_id bigint, poll_seq bigint, ord bigint, measured_at bigint, n bigint, t double, s string, d date"


def _fleet(name, query, poll, n, t=0.5, s="x", at=None):
    return (name, name and f"{name}_URL", name and "db", query, poll, poll, 60 * poll if at is None else at, n, t, s, dt.date(2024, 1, 1))


def test_keys_of_a_server_share_a_state(spark):
    """Forty statements of two servers, one of them late, one gone for a while: as each alone, in two states."""
    data = [[_fleet(k, q, 1, 10 * q) for k in "AB" for q in range(20)],
            [_fleet(k, q, 2, 10 * q + q, s=f"{q}\n'\"") for k in "AB" for q in range(20) if q != 7],
            [_fleet("A", q, 3, 30 * q) for q in range(20)] + [_fleet("A", 5, 2, 1), _fleet(None, None, 1, 1)],
            [_fleet("Z", 0, 1, 0, at=10_000)], [_fleet("A", 3, 2, 99)], [_fleet("Z", 0, 2, 0, at=20_000)]]
    stream = stream_counter_delta(_in_batches(spark, data, FLEET), ["config_name", "config_var_name", "database", "query_id"], ["n", "t"], "1 minute")
    base = workspace(spark, "test-shared-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in spark.read.parquet(f"{base}/out").collect() if r.config_name in ("A", "B")]
    want = {(k, q, 2): q for k in "AB" for q in range(20) if q not in (5, 7)} | {("B", 5, 2): 5}
    want |= {("A", q, 3): 19 * q for q in range(20) if q not in (5, 7)}
    assert {(r.config_name, r.query_id, r.poll_seq): r.n for r in got if not r.behind and r.query_id != 5} == {k: v for k, v in want.items() if k[1] != 5}
    # Two rows of one poll: the earlier rows pair with the first to arrive, and both with the next poll.
    assert sorted(r.n for r in got if (r.config_name, r.query_id, r.behind) == ("A", 5, False)) == [5, 95, 149]
    assert [(r.query_id, r.poll_seq, r.n) for r in got if r.behind] == [(3, 2, 99)]
    assert all(r.d == dt.date(2024, 1, 1) and r.t == 0 for r in got if not r.behind)
    assert {r.s for r in got if r.config_name == "B"} == {f"{q}\n'\"" for q in range(20) if q != 7}
    # A state, a timer and its place in time for each of A, B, Z and the server without a name.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 12


def test_counters_keep_every_value(spark):
    """Values that JSON lacks or rounds elsewhere: none, no number, infinite, over 2^53, the smallest double."""
    nan, inf, big = float("nan"), float("inf"), 2**62 + 1
    before = [(0, big, 0.1), (1, None, nan), (2, 1, inf), (3, -1, None), (4, 0, 0.0), (5, 0, 0.0)]
    after = [(0, big + 7, 0.3), (1, 5, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 0, 5e-324), (5, 0, -inf)]
    data = [[_fleet("A", q, 1, n, t) for q, n, t in before], [_fleet("A", q, 2, n, t, None) for q, n, t in after], [_fleet("Z", 0, 1, 0, at=10_000)]]
    keys = ["config_name", "config_var_name", "database", "query_id"]
    got = {r.query_id: r for r in drain(spark, stream_counter_delta(_in_batches(spark, data, FLEET), keys, ["n", "t"], "1 minute"), "t6").collect()}
    assert {q: r.n for q, r in got.items()} == {0: 7, 1: None, 2: 1, 3: 3, 4: 0, 5: 0} and all(r.s is None for r in got.values())
    assert got[0].t == 0.3 - 0.1 and got[1].t != got[1].t and got[2].t == -inf and got[3].t is None and got[4].t == 5e-324 and got[5].t == -inf


EVENTS = "config_name string, fingerprint string, event_id bigint, measured_at bigint, raw string, plan string"


def test_throttle_over_shuffled_files(spark):
    rows = [("A", "f", i, t, "x", f"p{i}") for i, t in enumerate([100, 100, 3700, 3699, 7300, 9000, 11000])]
    rows += [("B", "f", 10, 150, "x", "other server"), ("A", "f", 11, 50, "y" * 30_001, "too long")]
    data = [rows[2:5], rows[:2] + rows[7:], rows[5:7], [("Z", "f", 99, 10**6, "x", "")]]
    got = drain(spark, stream_explain_throttle(_in_batches(spark, data, EVENTS), "4 hours", ["config_name", "fingerprint"]), "t7").collect()
    assert sorted((r.config_name, r.event_id) for r in got if r.config_name != "Z") == [("A", 0), ("A", 2), ("A", 4), ("A", 6), ("B", 10)]


def test_throttle_marks_events_behind_its_decisions(spark):
    data = [[("A", "f", 1, 10_000, "x", "p")], [("Z", "f", 2, 11_000, "x", "p")], [("Z", "f", 5, 11_500, "x", "p")], [("A", "f", 3, 9_000, "x", "p")], [("Z", "f", 4, 10**6, "x", "p")]]
    got = drain(spark, stream_explain_throttle(_in_batches(spark, data, EVENTS), "1 minute", ["config_name", "fingerprint"]), "t8").collect()
    assert sorted((r.event_id, r.behind) for r in got if r.config_name == "A") == [(1, False), (3, True)]


SLOW = "config_name string, config_var_name string, database string, fingerprint string, payload_id bigint, pos int, measured_at bigint"
PLANS = "config_name string, config_var_name string, database string, fingerprint string, measured_at bigint, plan_id bigint, raw string, plan string"


def test_plans_reach_the_query_they_were_taken_of(spark):
    """Batch and stream agree with the rule, written out: last query of the statement up to a minute before."""
    rng = random.Random(3)
    events = [("A", "V", "d", rng.choice("fg"), i, 0, rng.randrange(0, 20_000, 7)) for i in range(400)]
    plans = [("A", "V", "d", rng.choice("fg"), rng.randrange(0, 20_000), i, "x" * (30_001 if i % 9 == 0 else 5), f"Filter: (id = {i})") for i in range(200)]
    plans += [("B", "V", "d", "f", 30, 500, "x", "of another server")]
    want = {}
    for key in "fg":
        last = None
        for at, plan in sorted((p[4], p[5]) for p in plans if p[0] == "A" and p[3] == key and len(p[6]) <= 30_000):
            if last is None or at >= last + 3600:
                last = at
                near = sorted((-e[6], e[4]) for e in events if e[3] == key and at - 60 <= e[6] <= at)
                if near:
                    want[near[0][1]] = "Filter: (id = ?)"
    batch = logs.attach_plans(spark.createDataFrame(events, SLOW), spark.createDataFrame(plans, PLANS)).collect()
    assert len(batch) == 400 and {r.payload_id: r.explain for r in batch if r.explain} == want and len(want) > 4
    rng.shuffle(events)
    rng.shuffle(plans)
    halves = lambda rows: [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    stream = stream_attach_plans(
        _in_batches(spark, halves(events), SLOW), _in_batches(spark, [*halves(plans), [("Z", "V", "d", "f", 10**6, 0, "x", "")]], PLANS), "6 hours"
    )
    got = drain(spark, stream, "t9").collect()
    assert len(got) == 400 and {r.payload_id: r.explain for r in got if r.explain} == want and not any(r.behind for r in got)


def test_windowed_counts_close_behind_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=s), "x") for s in (0, 30, 61, 600)]
    path = workspace(spark, "test") + "/in"
    spark.createDataFrame(rows, "at timestamp, k string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("at timestamp, k string").parquet(path)
    got = drain(spark, windowed_counts(stream, "at", ["k"], "2 minutes"), "windows").collect()
    assert sorted((r.report_start, r.n) for r in got) == [(t0, 2), (t0 + dt.timedelta(seconds=60), 1)]


def test_payload_files_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    (tmp_path / "b.log").write_text("three")
    batch = {r.body for r in read_log_payloads(spark, str(tmp_path)).collect()}
    assert batch == {"one\ntwo", "three"}
    seen = []
    query = each_batch(stream_log_payloads(spark, str(tmp_path)), lambda b: seen.append(b.count()), workspace(spark, "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 2


def test_snapshot_scan_skips_rows_without_required_values(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '{"config_name":"A","poll_seq":1,"indexrelid":5,"idx_blks_read":1,"idx_blks_hit":2}\n'
        '{"config_name":"A","poll_seq":1,"indexrelid":6,"idx_blks_read":1}\n{broken\n'
    )
    assert [r.indexrelid for r in read_snapshot(spark, "index_statio", str(tmp_path), "json").collect()] == [5]
    assert "idx_blks_hit" in read_snapshot(spark, "index_statio", str(tmp_path), "json").columns
    assert qs.TOP_PER_CATEGORY == 25
