import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.operators import querystats as qs
from fleetlens.schemas import BLOCK_COUNTERS

BASE = dict(
    config_name="A", config_var_name="A_URL", database="d", poll_seq=1, measured_at=60, ord=0, query_id=1,
    query="q", comment="", fingerprint="f", calls=1, total_time=1.0, rows=0, blk_read_time=0.0,
    blk_write_time=0.0, min_time=1.0, max_time=1.0, mean_time=1.0, total_blk_io_time=0.0,
    **{b: 0 for b in BLOCK_COUNTERS},
)


def frame(spark, *changes):
    return spark.createDataFrame([Row(**{**BASE, **c}) for c in changes])


def test_delta_subtracts_and_takes_text_from_the_later_poll(spark):
    df = frame(
        spark,
        dict(calls=40, total_time=6.0, query="old"),
        dict(poll_seq=2, measured_at=120, calls=48, total_time=18.0, query="new", blk_read_time=2.0, blk_write_time=3.0),
    )
    row = qs.query_stats_delta(df).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.poll_seq, row.calls, row.total_time, row.mean_time, row.query) == (2, 8, 12.0, 1.5, "new")
    assert (row.total_blk_io_time, row.measured_at) == (5.0, 120)


def test_valid_drops_resets(spark):
    df = frame(spark, {}, dict(total_time=0.0), dict(calls=0), dict(rows=-1), dict(local_blks_hit=-5), dict(shared_blks_read=-1))
    assert qs.query_stats_valid(df).count() == 2  # local blocks are not looked at


def test_rollup(spark):
    df = frame(spark, dict(calls=1, total_time=0.0, min_time=3.0, mean_time=9.0), dict(calls=2, total_time=5.0, min_time=2.0, ord=1, query="second"),
               dict(fingerprint="g", mean_time=7.0))
    got = {r.fingerprint: r for r in qs.fingerprint_rollup(df).collect()}
    assert (got["f"].calls, got["f"].mean_time, got["f"].min_time, got["f"].query) == (3, 1.6667, 2.0, "q")
    assert got["g"].mean_time == 7.0  # single rows keep their values


def greedy(rows, limit):
    taken = {}
    for name, key, floor in [("calls", "calls", 0), ("total_time", "total_time", 0), ("mean_time", "mean_time", 10), ("block_io", "total_blk_io_time", 10)]:
        left = [r for r in rows if r["calls"] > 0 and r["fingerprint"] not in taken and r[key] >= floor]
        for r in sorted(left, key=lambda r: (-r[key], r["fingerprint"]))[:limit]:
            taken[r["fingerprint"]] = name
    return taken


def test_worst_queries_equals_the_plain_greedy_passes(spark):
    rng = random.Random(3)
    rows = [
        {**BASE, "fingerprint": f"f{i:04d}", "calls": rng.randint(0, 30), "total_time": float(rng.randint(0, 20)),
         "mean_time": float(rng.randint(0, 25)), "total_blk_io_time": float(rng.randint(0, 25))}
        for i in range(400)
    ]
    df = spark.createDataFrame([Row(**r) for r in rows])
    picked = qs.worst_queries(df, limit=9)
    assert picked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.fingerprint: r.category for r in picked.collect()} == greedy(rows, 9)


def test_placeholder_passes_through_zeroed(spark):
    df = qs.missing_text_placeholder(frame(spark, dict(query="MISSING", fingerprint="", calls=9), dict(calls=5)))
    got = {r.fingerprint: r for r in qs.worst_queries(df).collect()}
    assert (got[""].category, got[""].calls, got[""].measured_at) == ("missing_text", 0, 0)
    assert got["f"].category == "calls"


def test_collector_statements_are_skipped_unless_kept(spark):
    df = spark.createDataFrame([("select 1 /* app:fleet-collector */",), ("select 1",), (None,)], "query string")
    assert {r.query for r in qs.normalize_text(df).collect()} == {"select ?", "MISSING"}
    kept = qs.normalize_text(df, keep_collector_queries=True)
    assert kept.count() == 3
    assert kept.filter(F.col("fingerprint") == "").count() == 1
    deep = spark.createDataFrame([("/* " + "x" * 2000 + " */ select 1 /* app:fleet-collector */",)], "query string")
    assert qs.normalize_text(deep).count() == 0  # the tag is found beyond the cut of the comment
    assert len(qs.normalize_text(deep, keep_collector_queries=True, comment_bytes=None).first().comment) > 2000
    other = qs.normalize_text(df, collector_tag="//app")
    assert other.count() == 3
