"""Run registered queries against their SQL twins: ``python -m verification.compare [dir] [keys...]``."""

from __future__ import annotations

import os
import sys
import time

from fleetlens.sources.workspace import ensure_shared

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    """A comparable text for any cell."""
    if value is None:
        return "NULL"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: normal(v) for k, v in sorted(value.items())})
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    if isinstance(value, float) and value == 0:
        return "0.0"
    return repr(value)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, run, sql: str) -> tuple[int, int, str]:
    """Row counts of both sides and an empty text when every value is equal."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    left = sorted(tuple(normal(row[c]) for c in columns) for row in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    rows = result.fetchall()
    if sorted(names) != columns:
        return len(left), len(rows), f"columns differ: {sorted(set(names) ^ set(columns))}"
    at = [names.index(c) for c in columns]
    right = sorted(tuple(normal(row[i]) for i in at) for row in rows)
    if left == right:
        return len(left), len(right), ""
    missing = [r for r in left if r not in set(right)][:1]
    extra = [r for r in right if r not in set(left)][:1]
    text = ""
    if missing and extra:
        other = max(set(right), key=lambda r: sum(a == b for a, b in zip(r, missing[0])))
        text = str([(c, a[:300], b[:300]) for c, a, b in zip(columns, missing[0], other) if a != b])
    return len(left), len(right), text or f"only spark {missing} only sql {extra}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared(spark)
    return spark


def main() -> int:
    os.environ["TZ"] = "UTC"
    time.tzset()
    from verification.oracles import ORACLES
    from verification.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), duck(sf_dir), 0
    for key in keys:
        start = time.time()
        try:
            if key not in ORACLES:
                n = QUERIES[key](spark, sf_dir).count()
                print(f"{key}: rows-only {n} {time.time() - start:.1f}s", flush=True)
                continue
            n, m, text = compare(spark, con, sf_dir, QUERIES[key], ORACLES[key])
            bad += bool(text)
            print(f"{key}: {n} {m} {'OK' if not text else 'DIFF ' + text[:1500]} {time.time() - start:.1f}s", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"{key}: ERR {str(error)[:1200]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
