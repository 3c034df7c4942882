"""Log payloads: prefilter, stitching, routing, slow queries, plan throttling.

A payload is self-contained, so everything up to the parsed line is a narrow
per-row expression: no shuffle in batch, no state in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.binding import let
from fleetlens.functions.logtext import key_values, log_timestamp, slow_query_line, syslog_line
from fleetlens.functions.text import COLLECTOR_TAG, obfuscate_explain
from fleetlens.operators.querystats import normalize_text
from fleetlens.schemas import SERVER

# --- fixed values: markers and limits -------------------------------------
PAYLOAD_MARKS = ["app postgres.", "heroku-postgres", "heroku-pgbouncer"]
METRIC_PROCESS = "heroku-postgres"
SQL_PROCESS_PREFIX = "postgres."
EXPLAIN_BYTES = 30000
EXPLAIN_SECONDS = 3600
PLAN_KEYS = (*SERVER, "fingerprint")
# A plan belongs to a slow query logged at most so many seconds before it was taken.
EXPLAIN_WITHIN = 60
# The text a collector raises to test log delivery; a deployment passes its own.
TEST_MARKER = "NOTICE:  FLEET_COLLECTOR_LOG_TEST"


def mentions_postgres(body: Column) -> Column:
    """Substring tests that spare the regex for unrelated payloads."""
    keep = F.lit(False)
    for mark in PAYLOAD_MARKS:
        keep = keep | F.contains(body, F.lit(mark))
    return keep


def log_prefilter(payloads: DataFrame) -> DataFrame:
    return payloads.filter(mentions_postgres(F.col("body")))


def log_test_marker(
    payloads: DataFrame, marker: str = TEST_MARKER, by: Sequence[str] = ()
) -> DataFrame:
    """Receipt time of the last payload received that carries the test marker."""
    return (
        payloads.filter(F.contains("body", F.lit(marker)))
        .groupBy(*by)
        .agg(F.unix_seconds(F.max("received_at")).alias("log_test_received_at"))
        .filter(F.col("log_test_received_at").isNotNull())
    )


def stitched_lines(body: Column) -> Column:
    """Array of (pos, process, segment, color, timestamp, message) of a payload.

    Lines of equal process and segment are concatenated in order onto the first.
    The lines are sorted by that pair once and cut at its changes, so the cost
    stays n log n for a long payload.
    """
    parsed = F.transform(
        F.split(body, "\n"),
        lambda line, i: let(
            syslog_line(line),
            lambda s: F.when(
                s.isNotNull() & (s["message"] != ""),
                F.struct(
                    s["process"].alias("process"), s["segment"].alias("segment"), i.alias("pos"),
                    s["color"].alias("color"), s["timestamp"].alias("timestamp"),
                    s["message"].alias("message"),
                ),
            ),
        ),
    )
    ordered = F.sort_array(F.filter(parsed, lambda line: line.isNotNull()))

    def starts(lines: Column) -> Column:
        def changes(line: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            new = (i == 0) | (before["process"] != line["process"]) | (before["segment"] != line["segment"])
            return F.when(new, i)

        return F.filter(F.transform(lines, changes), lambda i: i.isNotNull())

    def merged(lines: Column, cuts: Column) -> Column:
        def record(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(cuts, j + 1), F.size(lines))
            head = F.get(lines, start)
            return F.struct(
                head["pos"].alias("pos"), head["process"].alias("process"),
                head["segment"].alias("segment"), head["color"].alias("color"),
                head["timestamp"].alias("timestamp"),
                F.array_join(
                    F.transform(F.slice(lines, start + 1, end - start), lambda x: x["message"]), ""
                ).alias("message"),
            )

        return F.transform(cuts, record)

    return let(ordered, lambda lines: let(starts(lines), lambda cuts: merged(lines, cuts)))


def log_stitch(payloads: DataFrame) -> DataFrame:
    """One row per stitched record of every payload."""
    keep = [c for c in payloads.columns if c != "body"]
    return payloads.select(*keep, F.inline(stitched_lines(F.col("body"))))


def is_metric_line(process: Column) -> Column:
    return process == METRIC_PROCESS


def is_sql_line(process: Column) -> Column:
    return process.startswith(SQL_PROCESS_PREFIX)


def log_metrics(stitched: DataFrame) -> DataFrame:
    """The metric map of every metric line."""
    lines = stitched.filter(is_metric_line(F.col("process")))
    at = log_timestamp(F.col("timestamp"), F.unix_seconds("received_at"))
    return lines.withColumn("metrics", key_values(F.col("message"), at)).drop(
        "message", "timestamp", "process", "segment", "color"
    )


def _present(value: Column) -> Column:
    """The value as an array of one, or of none when NULL.

    Exploding it keeps only present values and evaluates them once; a filter on
    the value would be evaluated again by the projection above it.
    """
    return F.filter(F.array(value), lambda v: v.isNotNull())


def slow_query_lines(stitched: DataFrame) -> DataFrame:
    """Parsed duration messages; other statements' messages give no row."""
    carried = [c for c in stitched.columns if c not in ("message", "timestamp", "process", "segment")]
    return stitched.filter(is_sql_line(F.col("process"))).select(
        *carried,
        log_timestamp(F.col("timestamp"), F.unix_seconds("received_at")).alias("measured_at"),
        F.inline(_present(slow_query_line(F.col("message")))),
    )


def log_route(stitched: DataFrame) -> DataFrame:
    """Every handled record with its branch, ``metric`` or ``slow_query``."""
    process = F.col("process")
    branch = F.when(is_metric_line(process), "metric").when(
        is_sql_line(process) & slow_query_line(F.col("message")).isNotNull(), "slow_query"
    )
    return stitched.select(*stitched.columns, F.explode(_present(branch)).alias("branch"))


def _known(servers: DataFrame) -> DataFrame:
    """The first known server per config name, which log lines carry as their color."""
    return servers.groupBy(F.col("config_name").alias("color")).agg(F.min_by(F.struct(*SERVER), "ord").alias("_server"))


def slow_query_events(
    lines: DataFrame,
    servers: DataFrame,
    keep_collector_queries: bool = False,
    collector_tag: str = COLLECTOR_TAG,
) -> DataFrame:
    """Slow lines as statement statistics rows of their server.

    The server is the first known one whose config name equals the line's color;
    lines of unknown servers drop out.  The server side has one row per config
    name and is broadcast by the planner while it is small.
    """
    text = lines.withColumn("query", F.col("raw"))
    events = normalize_text(
        text, redact=False, keep_collector_queries=keep_collector_queries, collector_tag=collector_tag
    ).join(_known(servers), "color")
    duration = F.col("duration_ms")
    carried = [c for c in lines.columns if c not in ("color", "measured_at", "raw", "duration_ms", "metadata")]
    return events.select(
        "_server.*", "measured_at", *carried, "fingerprint", "query", F.col("raw"),
        F.lit(1).cast("bigint").alias("calls"),
        duration.alias("total_time"), duration.alias("min_time"), duration.alias("max_time"),
        F.lit(0.0).alias("mean_time"),
    )


def plan_events(
    plans: DataFrame,
    servers: DataFrame,
    keep_collector_queries: bool = False,
    collector_tag: str = COLLECTOR_TAG,
) -> DataFrame:
    """Plans taken of slow statements, with the server and fingerprint of the statement.

    ``plans`` carries ``config_name``, ``measured_at`` in seconds, ``plan_id``, the ``raw`` statement and
    the ``plan`` text; statements are normalised exactly as those of log lines.
    """
    text = plans.withColumnRenamed("config_name", "color").withColumn("query", F.col("raw"))
    return (
        normalize_text(text, redact=False, keep_collector_queries=keep_collector_queries, collector_tag=collector_tag)
        .join(_known(servers), "color")
        .select("_server.*", "fingerprint", "measured_at", "plan_id", "raw", "plan")
    )


def explain_throttle(
    events: DataFrame,
    keys: Sequence[str] = PLAN_KEYS,
    order: str = "event_id",
    gap: int = EXPLAIN_SECONDS,
    max_bytes: int = EXPLAIN_BYTES,
) -> DataFrame:
    """At most one plan per key and ``gap`` seconds, obfuscated; keys name the server too.

    Greedy from the last emission.  Before any grouping, events collapse to one
    per key and second (partial aggregation), which bounds a hot key by elapsed
    time instead of rows.  A pause of at least ``gap`` always re-opens the key, so
    a key falls into stretches that are dealt to tasks one by one; each is one
    ordered pass that remembers a single time, whatever its length.
    """
    keys = list(keys)
    short = events.filter(F.octet_length("raw") <= max_bytes)
    seconds = short.groupBy(*keys, "measured_at").agg(F.min(order).alias(order))
    by_time = Window.partitionBy(*keys).orderBy("measured_at")
    pause = F.col("measured_at") - F.lag("measured_at").over(by_time)
    stretches = seconds.withColumn("_new", F.coalesce(pause, F.lit(gap)) >= gap).withColumn(
        "_stretch", F.sum(F.col("_new").cast("int")).over(by_time)
    )
    by_stretch = [*keys, "_stretch"]
    # No ``repartition`` by number here: adaptive execution sizes the shuffle.
    passes = stretches.repartition(*by_stretch).sortWithinPartitions(*by_stretch, "measured_at")
    at, fresh = passes.columns.index("measured_at"), passes.columns.index("_new")

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            taken = []
            for i, (time, new) in enumerate(zip(batch.column(at).to_pylist(), batch.column(fresh).to_pylist())):
                if new or time >= last + gap:
                    last = time
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int32()))

    chosen = passes.mapInArrow(emitted, passes.schema)
    return short.join(chosen.select(*keys, "measured_at", order), [*keys, "measured_at", order]).withColumn(
        "plan", obfuscate_explain(F.col("plan"))
    )


def attach_plans(
    events: DataFrame,
    plans: DataFrame,
    event_id: Sequence[str] = ("payload_id", "pos"),
    within: int = EXPLAIN_WITHIN,
    gap: int = EXPLAIN_SECONDS,
    max_bytes: int = EXPLAIN_BYTES,
) -> DataFrame:
    """Slow queries with ``explain``, the throttled plan taken of them (NULL for most).

    A plan belongs to the last query of its server and fingerprint logged at most ``within`` seconds
    before it (of several in a second, the one with the smallest id); a plan without such a query counts
    for the throttle and reaches nothing.  The interval join is an equi-join on slots of that width, so
    a frequent statement is spread over time, and only identifiers take part in it.
    """
    if within >= gap:
        raise ValueError("plans must be further apart than a plan is from its query")
    keys, event_id = list(PLAN_KEYS), list(event_id)
    taken = explain_throttle(plans, keys, "plan_id", gap, max_bytes).select(*keys, "plan_id", F.col("measured_at").alias("_taken"), "plan")
    width = within + 1

    def slot(at: Column) -> Column:
        return F.floor(at / width)

    near = taken.select(*keys, "plan_id", "_taken", F.explode(F.array(slot(F.col("_taken")), slot(F.col("_taken")) - 1)).alias("_slot")).join(
        events.select(*keys, *event_id, "measured_at", slot(F.col("measured_at")).alias("_slot")), [*keys, "_slot"]
    )
    near = near.filter((F.col("measured_at") <= F.col("_taken")) & (F.col("measured_at") >= F.col("_taken") - within))
    chosen = near.groupBy(*keys, "plan_id").agg(
        F.min_by(F.struct(*event_id), F.struct(-F.col("measured_at"), *event_id)).alias("_event")
    )
    explained = chosen.join(taken, [*keys, "plan_id"]).select(*keys, *[F.col("_event")[c].alias(c) for c in event_id], F.col("plan").alias("explain"))
    return events.join(explained, [*keys, *event_id], "left").select(*events.columns, "explain")
