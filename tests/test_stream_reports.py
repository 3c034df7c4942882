import pytest
from pyspark.sql import functions as F

from fleetlens.operators.metrics import metric_series
from fleetlens.sources.tables import read_log_batches, write_log_batches
from fleetlens.sources.workspace import workspace
from fleetlens.streaming.reports import report_all, report_batches, reports, rows_behind, rows_received, stream_reports, together

ROWS = "id long, at timestamp"


def _counts(parts):
    return parts["a"].groupBy(F.date_trunc("minute", "at").alias("minute")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("at"))


def _ids(frame):
    return sorted(tuple(r.ids) for r in frame.collect())


def _in_batches(spark, parts):
    path = workspace(spark, "test") + "/in"
    for part in parts:
        _frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)


def test_an_interval_is_reported_once_when_the_watermark_has_passed(spark):
    parts = [[(1, 0), (2, 61)], [(3, 30), (4, 100)], [(5, 300)], [(6, 10), (7, 310), (8, None)], [(9, 900)]]
    base = workspace(spark, "t")
    report_all(spark, stream_reports({"a": (_in_batches(spark, parts), "at")}, _counts, base, 60))
    assert _ids(reports(spark, base)) == [(1, 3), (2, 4), (5, 7)]
    assert sorted(r.id for r in rows_behind(spark, base, "a").collect()) == [6, 8]
    assert sorted(tuple(r) for r in rows_received(spark, base).collect()) == [(0, 2, 0), (1, 2, 0), (2, 1, 0), (3, 3, 2), (4, 1, 0)]


def test_a_repeated_batch_writes_nothing_twice(spark):
    base = workspace(spark, "t")
    run = report_batches(base, {"a": None}, _counts, 0)
    first, second = (together({"a": (_frame(spark, rows), "at")}) for rows in ([(1, 0), (2, 130)], [(3, 200)]))
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        run(batch, number)
    assert _ids(reports(spark, base)) == [(1,), (2,)]


def test_a_batch_that_failed_before_its_entry_is_done_again(spark):
    base = workspace(spark, "t")

    def broken(parts):
        raise RuntimeError("executor lost")

    batch = together({"a": (_frame(spark, [(1, 0), (2, 130)]), "at")})
    with pytest.raises(RuntimeError):
        report_batches(base, {"a": None}, broken, 0)(batch, 0)
    report_batches(base, {"a": None}, _counts, 0)(batch, 0)
    assert _ids(reports(spark, base)) == [(1,)]


def test_the_slowest_stream_holds_the_report(spark):
    base = workspace(spark, "t")
    run = report_batches(base, {"a": None, "b": None}, _counts, 0)
    a = together({"a": (_frame(spark, [(1, 0), (2, 500)]), "at"), "b": (_frame(spark, []), "at")})
    b = together({"a": (_frame(spark, [(3, 20)]), "at"), "b": (_frame(spark, [(1, 70)]), "at")})
    run(a, 0)
    run(b, 1)
    assert _ids(reports(spark, base)) == [(1, 3)]


def test_log_batches_keep_their_receipt_and_skip_what_is_no_payload(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.sql("select 1L as payload_id, timestamp_seconds(70) as received_at, 'a\\nb \u00e9' as body union all select 2L, null, 'x'")
    write_log_batches(rows, path)
    (tmp_path / "in" / "other.json").write_text("not a payload\n")
    got = read_log_batches(spark, path).withColumn("received_at", F.unix_seconds("received_at")).collect()
    assert [tuple(r) for r in got] == [(1, 70, "a\nb \u00e9")]


def test_a_series_needs_a_bound(spark):
    rows = spark.sql("select 'c' as config_name, 'n' as name, '' as entity, cast(id as double) as value, id * 50 as measured_at from range(4)")
    with pytest.raises(ValueError):
        metric_series(rows)
    got = metric_series(rows, order=["measured_at"], segment_seconds=100).orderBy("segment").collect()
    assert [(r.segment, len(r["values"])) for r in got] == [(0, 2), (1, 2)]
