"""What keeps the work of a query in proportion to its input."""

import re
import time

from pyspark.sql import functions as F

from fleetlens import functions as L
from fleetlens.plans.slow_query_report import slow_query_report
from fleetlens.sources.workspace import CLEANUP, FINE, FINE_SCAN, SCAN, SCAN_DEFAULT, fine_shuffles, landed
from verification import queries as q
from verification.fixtures import derived_once, fixture


def test_parts_of_a_stream_in_several_files_stay_apart(spark, monkeypatch):
    """Each micro-batch reads all files of one part and none of another."""
    monkeypatch.setattr(q, "FILE_ROWS", 50)
    rows = spark.range(900).select("id", (F.col("id") * 10).alias("measured_at"))
    filed, delay, later = q._out_of_order(rows, "id")
    stream = q._in_files(spark, filed, "test-parts", q._one_row(spark, filed, id=-1, measured_at=later))
    seen = []

    def look(batch, _):
        seen.append(({r["id"] for r in batch.collect()}, len({r[0] for r in batch.select(F.input_file_name()).collect()})))

    run = stream.writeStream.foreachBatch(look).option("checkpointLocation", q.workspace(spark, "test-look")).trigger(availableNow=True).start()
    run.awaitTermination()
    parts = {k: {r["id"] for r in filed.filter(F.col("_file") == k).collect()} for k in range(4)}
    assert [ids for ids, _ in seen] == [*parts.values(), {-1}]
    assert all(files > 1 for _, files in seen[:4])


def test_shared_fixtures_are_derived_once_a_query(spark, sf):
    with derived_once():
        inside = [fixture(spark, sf, name) for name in ("pg_index", "index_statio", "pg_stats")]
    folders = {file.rsplit("/", 1)[0] for frame in inside for file in frame.inputFiles()}
    assert len(folders) == 1 and "fixture-index_rows" in folders.pop()
    for name, frame in zip(("pg_index", "index_statio", "pg_stats"), inside):
        assert frame.exceptAll(fixture(spark, sf, name)).isEmpty() and fixture(spark, sf, name).exceptAll(frame).isEmpty()


def test_shuffles_start_fine_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(FINE, None)
    try:
        spark.conf.unset(FINE)
        fine_shuffles(spark)
        assert int(spark.conf.get(FINE)) >= 1000
        fine_shuffles(spark, False)
        assert spark.conf.get(FINE, None) is None
        spark.conf.set(FINE, "7")
        fine_shuffles(spark)
        fine_shuffles(spark, False)
        assert spark.conf.get(FINE) == "7"
    finally:
        spark.conf.unset(FINE) if before is None else spark.conf.set(FINE, before)


def test_a_version_is_taken_apart_once(spark):
    rows = spark.createDataFrame([("1.2.0", "1.2"), ("1.2-a", "1.2-b"), ("x..", "1"), ("2.0", "10")], "a string, b string")
    compared = rows.select(L.version_compare(F.col("a"), F.col("b")).alias("c"))
    assert compared._jdf.queryExecution().analyzed().toString().count("regexp_extract") <= 6
    assert [r["c"] for r in compared.collect()] == [0, -1, None, -1]


def test_a_report_of_slow_queries_reads_logs_and_plans_once(spark):
    line = (
        "300 <134>1 2024-01-01T00:00:0{0}+00:00 host app postgres.7 - [A_0] [{0}-1]  sql_error_code = 00000 pid=\"7\""
        " LOG:  duration: 12.5 ms  execute <unnamed>: SELECT * FROM t WHERE id = {0}"
    )
    payloads = spark.createDataFrame([(k, line.format(k)) for k in (1, 2)], "payload_id long, body string")
    payloads = payloads.withColumn("received_at", F.timestamp_seconds(F.lit(1704067210)))
    servers = spark.createDataFrame([("A_0", "A_0_URL", "db", 1)], "config_name string, config_var_name string, database string, ord long")
    plans = spark.createDataFrame(
        [("A_0", 1704067203, 5, "SELECT * FROM t WHERE id = 9", "Seq Scan")],
        "config_name string, measured_at long, plan_id long, raw string, plan string",
    )
    report = slow_query_report(payloads, servers, plans)
    assert {(r["payload_id"], r["explain"]) for r in report.collect()} == {(1, None), (2, "Seq Scan")}
    folders = {file.rsplit("/", 2)[1].rsplit("-", 1)[0] for file in report.inputFiles()}
    assert folders == {"fleetlens-slow-events", "fleetlens-slow-plans"}


def _shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return set(re.findall(r"shuffle_(\d+)_", blocks))


def test_a_landed_step_leaves_no_shuffle_files(spark):
    rows = spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    setting, before = spark.conf.get(CLEANUP, None), _shuffles(spark)
    step = landed(rows, "test-step")
    assert sorted(r["count"] for r in step.collect()) == [142, 143, 143, 143, 143, 143, 143]
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before and spark.conf.get(CLEANUP, None) == setting


def test_documents_are_put_together_from_written_parts(spark, sf):
    """The last plan shuffles the parts of documents, none of the steps that lead to them."""
    with derived_once():
        documents = q._documents(spark, sf)
    folders = {re.sub("-[0-9a-f]+$", "", f.rsplit("/", 2)[1]) for f in documents.inputFiles()}
    assert "fleetlens-report-servers" in folders
    assert not folders & {"fleetlens-fixture-index_rows", "fleetlens-fixture-table_rows", "fleetlens-fixture-cells_statement"}
    assert documents._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20


def test_scans_start_fine_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(SCAN)
    try:
        spark.conf.unset(SCAN)
        fine_shuffles(spark)
        assert spark.conf.get(SCAN) == FINE_SCAN
        fine_shuffles(spark, False)
        assert spark.conf.get(SCAN).removesuffix("b") == SCAN_DEFAULT
        spark.conf.set(SCAN, "1000")
        fine_shuffles(spark)
        fine_shuffles(spark, False)
        assert spark.conf.get(SCAN) == "1000"
    finally:
        spark.conf.set(SCAN, before)
