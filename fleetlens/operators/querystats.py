"""Statement statistics: scan, text, delta, rollup, worst queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.numeric import ratio4
from fleetlens.functions.version import version_gte
from fleetlens.operators.deltas import adjacent_pairs
from fleetlens.operators.rows import drop_nulls
from fleetlens.schemas import BLOCK_COUNTERS, POLL, POLL_AT, REQUIRED, SERVER

NEW_TIME_NAMES_SINCE = "13.0"
IDENTITY = ["query_id", "query", "comment"]
COUNTERS = ["calls", "total_time", "rows", *BLOCK_COUNTERS, "blk_read_time", "blk_write_time"]
GAUGES = ["min_time", "max_time"]
DERIVED = ["mean_time", "total_blk_io_time"]

# --- fixed values: selection limits ---------------------------------------
TOP_PER_CATEGORY = 25
SLOW_MS = 10.0


def statement_stats(statements: DataFrame, databases: DataFrame, versions: DataFrame) -> DataFrame:
    """Statements of the current database, time columns chosen by server version."""
    current = databases.filter(F.col("datname") == F.col("database")).select(
        *POLL, F.col("oid").alias("dbid")
    )
    # One comparison per server, not per statement.
    renamed = versions.select(*SERVER, version_gte(F.col("version"), F.lit(NEW_TIME_NAMES_SINCE)).alias("_renamed"))
    times = {
        f"{kind}_time": F.when(F.col("_renamed"), F.col(f"{kind}_exec_time")).otherwise(F.col(f"{kind}_time"))
        for kind in ("total", "min", "max")
    }
    timed = (
        drop_nulls(statements, REQUIRED["statements"])
        .join(current, [*POLL, "dbid"])
        .join(renamed, SERVER, "left")
        .withColumns(times)
    )
    return drop_nulls(timed, times).select(*POLL_AT, "ord", "query_id", "query", *COUNTERS, *GAUGES)


def _is_collector_row(raw: Column, comment: Column, tag: str) -> Column:
    """The comment holds the collector tag.

    The optimizer pushes this filter down to the scan, where it would extract the
    comments of every row.  A tag that neither spans two joined comments nor holds
    redacted text must stand in the raw text already, a plain substring test.
    """
    marked = tx.is_collector_comment(comment, tag)
    if "//" in tag or tx.REDACTED in tag:
        return marked
    return F.coalesce(F.contains(raw, F.lit(tag)), F.lit(False)) & marked


def without_collector_rows(
    rows: DataFrame, text: str = "query", collector_tag: str = tx.COLLECTOR_TAG, redacted: str | None = None
) -> DataFrame:
    """Rows whose comments do not hold the collector tag; ``redacted`` names a redacted copy of the text."""
    comment = F.coalesce(tx.all_comments(F.col(redacted or text)), F.lit(""))
    return rows.filter(~_is_collector_row(F.col(text), comment, collector_tag))


def normalize_text(
    rows: DataFrame,
    text: str = "query",
    redact: bool = True,
    keep_collector_queries: bool = False,
    collector_tag: str = tx.COLLECTOR_TAG,
    comment_bytes: int | None = tx.COMMENT_BYTES,
    query_bytes: int | None = tx.QUERY_BYTES,
) -> DataFrame:
    """Comment, cleaned obfuscated text and fingerprint of a statement column.

    NULL text becomes the missing marker with an empty fingerprint.  Statements
    carrying the collector tag are dropped unless kept on request; the tag is looked
    for in whole comments.  ``None`` leaves comments or texts uncut.
    """
    source = F.col(text)
    out = rows.withColumn("_source", tx.redact_ip(source) if redact else source)
    if not keep_collector_queries:
        out = without_collector_rows(out, text, collector_tag, "_source")
    out = out.withColumn("comment", F.coalesce(tx.query_comment(F.col("_source"), comment_bytes), F.lit("")))
    return (
        out.withColumn("_plain", tx.obfuscate_query(tx.strip_comments(F.col("_source"))))
        .withColumn("_clean", tx.clean_query(F.col("_plain")))
        .withColumn(
            "fingerprint",
            F.when(F.col("_clean").isNull(), "").otherwise(tx.fingerprint(F.col("_clean"))),
        )
        .withColumn(text, F.coalesce(tx.truncate_query(F.col("_clean"), query_bytes), F.lit(tx.MISSING_TEXT)))
        .drop("_source", "_plain", "_clean")
    )


def query_stats_delta(stats: DataFrame) -> DataFrame:
    """Change of every counter against the adjacent earlier poll, by query id.

    Each earlier row pairs with the first current row of its id; text and
    min/max come from the current row, the order from the earlier one.
    """
    later = [*IDENTITY, "fingerprint", "measured_at", *COUNTERS, *GAUGES]
    pairs = adjacent_pairs(stats, [*SERVER, "query_id"], later)
    return (
        pairs.select(
            *SERVER,
            (F.col("poll_seq") + 1).alias("poll_seq"),
            F.col("next.measured_at").alias("measured_at"),
            "ord",
            *[F.col(f"next.{c}").alias(c) for c in [*IDENTITY, "fingerprint", *GAUGES]],
            *[(F.col(f"next.{c}") - F.col(c)).alias(c) for c in COUNTERS],
        )
        .withColumn("mean_time", ratio4(F.col("total_time"), F.col("calls")))
        .withColumn("total_blk_io_time", F.col("blk_read_time") + F.col("blk_write_time"))
    )


def query_stats_valid(delta: DataFrame) -> DataFrame:
    """Drop deltas that a statistics reset or an eviction made meaningless."""
    not_negative = [
        "rows", "shared_blks_hit", "shared_blks_read", "shared_blks_dirtied", "shared_blks_written",
        "blk_read_time", "blk_write_time", "total_blk_io_time",
    ]
    condition = (F.col("total_time") > 0) & (F.col("calls") > 0)
    for name in not_negative:
        condition = condition & (F.col(name) >= 0)
    return delta.filter(condition)


def fingerprint_rollup(delta: DataFrame) -> DataFrame:
    """Merge the rows of one fingerprint within a server poll.

    Aggregates partially before the shuffle, so a fingerprint shared by most
    rows costs one row per map task.
    """
    first = F.min_by(F.struct(*IDENTITY), F.col("ord"))
    single = F.count(F.lit(1)) == 1
    total, calls = F.sum("total_time"), F.sum("calls")
    io = F.sum("blk_read_time") + F.sum("blk_write_time")
    rolled = delta.groupBy(*POLL, "fingerprint").agg(
        first.alias("_first"),
        F.min("ord").alias("ord"),
        F.max("measured_at").alias("measured_at"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.min("min_time").alias("min_time"),
        F.max("max_time").alias("max_time"),
        F.when(single, F.max("mean_time")).otherwise(ratio4(total, calls)).alias("mean_time"),
        F.when(single, F.max("total_blk_io_time")).otherwise(io).alias("total_blk_io_time"),
    )
    return rolled.select(
        *POLL_AT, "ord", "_first.*", "fingerprint", *COUNTERS, *GAUGES, *DERIVED
    )


def is_placeholder() -> Column:
    return (F.col("query") == tx.MISSING_TEXT) & (F.col("fingerprint") == "")


def missing_text_placeholder(rolled: DataFrame) -> DataFrame:
    """Zero the row that stands for statements without text.

    After the rollup all of them share the empty fingerprint, hence at most one
    per server poll; it is replaced in place by an empty placeholder.
    """
    zeroed = ["query_id", "measured_at", "ord", *COUNTERS, *GAUGES, *DERIVED]
    types = dict(rolled.dtypes)
    missing = is_placeholder()
    return rolled.withColumns(
        {c: F.when(missing, F.lit(0).cast(types[c])).otherwise(F.col(c)) for c in zeroed}
        | {"comment": F.when(missing, "").otherwise(F.col("comment"))}
    )


def worst_queries(rolled: DataFrame, limit: int = TOP_PER_CATEGORY, slow_ms: float = SLOW_MS) -> DataFrame:
    """The worst statements of every server poll, with the category that chose them.

    Four passes by calls, total time, mean time and block IO time; each takes the
    next ``limit`` rows no earlier pass took, the last two only rows of at least
    ``slow_ms``.  Placeholder rows pass through.  Ties go to the smaller fingerprint.

    Every pass ranks within the server poll, rows that are still open first, so one
    shuffle serves all four.
    """
    measures = [("calls", "calls"), ("total_time", "total_time"), ("mean_time", "mean_time"),
                ("block_io", "total_blk_io_time")]
    slow_only = {"mean_time", "total_blk_io_time"}
    out = rolled.withColumn("_hold", is_placeholder()).filter(F.col("_hold") | (F.col("calls") > 0))
    out = out.withColumn("category", F.when(F.col("_hold"), F.lit("missing_text")))
    for name, measure in measures:
        eligible = F.col(measure) >= slow_ms if measure in slow_only else F.lit(True)
        out = out.withColumn("_open", F.coalesce(F.col("category").isNull() & eligible, F.lit(False)))
        order = [F.col("_open").desc(), F.col(measure).desc(), F.col("fingerprint").asc()]
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*POLL).orderBy(*order)))
        out = out.withColumn(
            "category",
            F.when(F.col("_open") & (F.col("_rank") <= limit), F.lit(name)).otherwise(F.col("category")),
        )
    return out.filter(F.col("category").isNotNull()).drop("_hold", "_open", "_rank")
