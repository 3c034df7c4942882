"""Poll-to-poll counter deltas.

Two pairings exist.  *Adjacent*: a row pairs only with the very next poll of its
server, so a statement that skipped a poll yields nothing.  *Lag*: a row pairs
with the last earlier row, however old.

Both are a single shuffle of the data.  Histories are cut into buckets of polls,
so neither a busy server nor a long-lived key ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKET_POLLS = 64


def _with_next_poll(
    rows: DataFrame, keys: Sequence[str], poll: str, bucket_polls: int, following: Column
) -> DataFrame:
    """Rows with ``next`` = an aggregate over the rows of the same keys one poll later.

    The first poll of a bucket is also copied to the bucket before it, where it
    serves only as a successor: 1/``bucket_polls`` extra rows buy windows that
    never exceed ``bucket_polls`` polls of one key, and no self-join is needed.
    """
    home = F.floor(F.col(poll) / bucket_polls)
    buckets = F.when(F.col(poll) % bucket_polls == 0, F.array(home, home - 1)).otherwise(F.array(home))
    span = Window.partitionBy(*keys, "_bucket").orderBy(poll).rangeBetween(1, 1)
    return (
        rows.withColumn("_bucket", F.explode(buckets))
        .withColumn("next", following.over(span))
        .filter(F.col("_bucket") == home)
        .drop("_bucket")
    )


def adjacent_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    poll: str = "poll_seq",
    order: str = "ord",
    bucket_polls: int = BUCKET_POLLS,
) -> DataFrame:
    """Each row that has a successor, with ``next`` = the successor's payload.

    The successor is the first row (by ``order``) with the same keys one poll later.
    """
    first = F.min_by(F.struct(*payload), F.col(order))
    return _with_next_poll(rows, keys, poll, bucket_polls, first).filter(F.col("next").isNotNull())


def all_adjacent_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    previous: Sequence[str],
    poll: str = "poll_seq",
    bucket_polls: int = BUCKET_POLLS,
) -> DataFrame:
    """Later rows with ``prev`` = an adjacent earlier row, duplicates multiplying."""
    every = F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))
    return (
        _with_next_poll(rows, keys, poll, bucket_polls, every)
        .select(*keys, F.struct(*previous).alias("prev"), F.explode("next").alias("next"))
        .select(*keys, "prev", "next.*")
    )


def lag_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    previous: Sequence[str],
    poll: str = "poll_seq",
    bucket_polls: int = 4096,
) -> DataFrame:
    """Each row with ``prev`` = the payload of the last earlier row of its key.

    Within a bucket this is a plain lag.  The first row of a bucket takes the
    last row of the closest earlier bucket, found on one summary row per bucket.
    The summary takes whole rows, so that both sides read the same exchange of the input by key
    and bucket, which the planner reuses: one scan and one shuffle of the data.
    """
    own = [c for c in rows.columns if c not in keys]
    # A struct is never NULL, so the join below adds no condition that would tell the two exchanges apart.
    key = F.struct(*[F.col(k) for k in keys], F.floor(F.col(poll) / bucket_polls).alias("_bucket")).alias("_key")
    bucketed = rows.select(key, *own).repartition(F.col("_key"))
    payload = F.struct(*previous)
    inside = bucketed.withColumn("prev", F.lag(payload).over(Window.partitionBy("_key").orderBy(poll)))
    tails = bucketed.groupBy("_key").agg(F.max_by(F.struct(*own), F.col(poll)).alias("_tail"))
    buckets = Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy("_key._bucket")
    carried = tails.select("_key", F.lag("_tail").over(buckets).alias("_carried"))
    last = F.when(F.col("_carried").isNotNull(), F.struct(*[F.col(f"_carried.{c}") for c in previous]))
    return inside.join(carried, "_key", "left").select(
        *[F.col(f"_key.{c}" if c in keys else c).alias(c) for c in rows.columns], F.coalesce("prev", last).alias("prev")
    )


def minus(later: str, earlier: str) -> Column:
    return F.col(later) - F.col(earlier)


def clamp0(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("bigint"))
