import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlens.operators import fold, logs

T0 = dt.datetime(2024, 1, 1)


def payloads(spark, *bodies):
    return spark.createDataFrame([(i, T0, b) for i, b in enumerate(bodies)], "payload_id bigint, received_at timestamp, body string")


def line(process, segment, message, color="TEAL"):
    return f"219 <158>1 2031-02-03T04:05:06+00:00 host app {process} - [{color}] [{segment}] {message}"


def test_stitching(spark):
    body = "\n".join([line("postgres.31", "7-1", " select"), line("postgres.32", "7-1", " other"), line("postgres.31", "7-2", " more"),
                      "noise", line("postgres.31", "8-1", " next")])
    got = logs.log_stitch(payloads(spark, body)).orderBy("pos").collect()
    assert [(r.process, r.segment, r.message) for r in got] == [
        ("postgres.31", "7", " select more"), ("postgres.32", "7", " other"), ("postgres.31", "8", " next")]


def test_stitching_a_long_payload_matches_plain_python(spark):
    rng = random.Random(5)
    parts = [(f"postgres.{rng.randint(1, 9)}", rng.randint(1, 20), f"m{i}") for i in range(3000)]
    want = {}
    for process, segment, message in parts:
        want[(process, str(segment))] = want.get((process, str(segment)), "") + message
    body = "\n".join(line(p, f"{s}-1", m) for p, s, m in parts)
    got = {(r.process, r.segment): r.message for r in logs.log_stitch(payloads(spark, body)).collect()}
    assert got == want


def test_metric_lines_without_segment_are_glued(spark):
    text = "77 <158>1 2030-01-01T00:00:00+00:00 host app heroku-postgres - "
    body = text + "source=A x=1\n" + text + "source=B y=2"
    row = logs.log_metrics(logs.log_stitch(payloads(spark, body))).first()
    assert row.metrics == {"timestamp": "1893456000", "source": "A", "y": "2"}  # the joint has two equal signs


def test_throttle_is_greedy_from_the_last_emission(spark):
    rng = random.Random(7)
    data = [(i, f"f{rng.randint(0, 2)}", rng.randint(0, 40000), "x" * (30001 if i % 17 == 0 else 3), "p") for i in range(600)]
    events = spark.createDataFrame(data, "event_id bigint, fingerprint string, measured_at bigint, raw string, plan string")
    want, last = set(), {}
    for i, f, at, raw, _ in sorted(data, key=lambda d: (d[2], d[0])):
        if len(raw) <= 30000 and (f not in last or at >= last[f] + 3600):
            last[f] = at
            want.add(i)
    assert {r.event_id for r in logs.explain_throttle(events, ["fingerprint"]).collect()} == want


def test_throttle_of_one_hot_key_without_a_pause(spark):
    """A statement that is slow every second for a day: one stretch, no array of its times."""
    events = spark.range(0, 86_400 * 3).selectExpr(
        "id as event_id", "'A' as config_name", "'f' as fingerprint", "cast(id div 3 as bigint) as measured_at", "'x' as raw", "'p' as plan"
    )
    throttled = logs.explain_throttle(events, ["config_name", "fingerprint"])
    assert "collect_list" not in throttled._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.event_id for r in throttled.collect()) == [3 * 3600 * i for i in range(24)]


def test_error_cap(spark):
    def run(panics):
        rows = [(i, T0, "e", p, "") for i, p in enumerate(panics)]
        df = spark.createDataFrame(rows, "seq bigint, event_time timestamp, error string, panic boolean, stack_trace string")
        return sorted(r.seq for r in fold.error_cap(df).collect())

    assert run([False] * 15) == list(range(10))
    assert run([False] * 11 + [True, True]) == [*range(10), 11]
    assert run([False] * 3 + [True] + [False] * 9 + [True]) == list(range(10))


def test_fold_servers(spark):
    rows = [("A", "A_URL", 1, 10, "14.1", 5, "heroku"), ("A", "A_URL", 2, 20, "", 0, "unknown"), ("B", "B_URL", 1, 7, "", 0, "unknown")]
    df = spark.createDataFrame(rows, "config_name string, config_var_name string, ord bigint, monitored_at bigint, version string, max_connections bigint, platform string")
    df = df.withColumn("pooler", F.lit(None).cast("struct<max_server_connections:bigint,version:string>"))
    got = {r.config_name: r for r in fold.fold_servers(df).collect()}
    assert (got["A"].monitored_at, got["A"].version, got["A"].max_connections, got["A"].platform) == (20, "14.1", 5, "heroku")
    assert (got["B"].version, got["B"].max_connections) == ("", 0)
