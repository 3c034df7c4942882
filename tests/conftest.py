import os
import time

import pytest

os.environ["TZ"] = "UTC"
time.tzset()

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on one row of values."""
    from pyspark.sql import functions as F

    def run(fn, *args):
        names = [f"c{i}" for i in range(len(args))]
        kinds = {str: "string", float: "double", int: "bigint", type(None): "string"}
        schema = ", ".join(f"{n} {kinds[type(a)]}" for n, a in zip(names, args))
        return spark.createDataFrame([args], schema).select(fn(*[F.col(n) for n in names])).first()[0]

    return run
