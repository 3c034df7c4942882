from pyspark.sql import functions as F

from fleetlens.operators.deltas import adjacent_pairs, all_adjacent_pairs, lag_pairs


def rows(spark, data):
    return spark.createDataFrame(data, "k string, poll_seq bigint, ord bigint, n bigint")


def test_skipped_poll_gives_no_delta(spark):
    df = rows(spark, [("a", 1, 0, 10), ("a", 3, 0, 30), ("a", 4, 0, 45)])
    got = adjacent_pairs(df, ["k"], ["n"]).select("poll_seq", F.col("next.n") - F.col("n")).collect()
    assert [tuple(r) for r in got] == [(3, 15)]


def test_pairs_cross_bucket_edges(spark):
    df = rows(spark, [("a", p, 0, p * p) for p in range(0, 200)])
    for size in (1, 2, 64):
        got = adjacent_pairs(df, ["k"], ["n"], bucket_polls=size).select("poll_seq", F.col("next.n") - F.col("n")).collect()
        assert sorted(tuple(r) for r in got) == [(p, 2 * p + 1) for p in range(0, 199)]


def test_every_earlier_row_meets_the_first_current_row(spark):
    df = rows(spark, [("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 5, 10), ("a", 2, 4, 20)])
    got = adjacent_pairs(df, ["k"], ["n"]).select("n", "next.n").collect()
    assert sorted(tuple(r) for r in got) == [(1, 20), (2, 20)]


def test_duplicates_multiply(spark):
    df = rows(spark, [("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 5, 10), ("a", 2, 4, 20)])
    got = all_adjacent_pairs(df, ["k"], ["n"]).select("prev.n", "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, 10), (1, 20), (2, 10), (2, 20)]


def test_lag_reaches_over_empty_buckets(spark):
    polls = [1, 2, 9, 10, 40, 41, 300]
    df = rows(spark, [("a", p, 0, p) for p in polls] + [("b", 5, 0, 5)])
    for size in (1, 4, 4096):
        got = lag_pairs(df, ["k"], ["n"], bucket_polls=size).select("k", "poll_seq", "prev.n").collect()
        want = [("a", p, b) for p, b in zip(polls, [None, *polls])] + [("b", 5, None)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_lag_pairs_shuffle_the_input_once(spark):
    """The summary of the buckets reads the exchange of the rows."""
    df = spark.createDataFrame([("a", p, p, p * p) for p in range(20)], "k string, poll_seq long, at long, n long")
    pairs = lag_pairs(df, ["k"], ["n"], bucket_polls=4)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
