"""Every registered query against its SQL twin on the smallest data, and plan checks."""

import pytest

from verification.compare import compare, duck
from verification.oracles import ORACLES
from verification.queries import QUERIES

# The ordered pass of the throttle runs inside Python tasks.
IN_PYTHON = {"explain_throttle", "slow_query_report", "slow_query_plans", "report_statements"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_result_on_the_jvm(spark, sf, con, key):
    df = QUERIES[key](spark, sf)
    n, m, text = compare(spark, con, sf, lambda *_: df, ORACLES[key])
    assert text == "" and n == m and n > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert key in IN_PYTHON or "Python" not in plan
    assert "CartesianProduct" not in plan


def test_every_query_without_twin_is_known():
    assert set(QUERIES) - set(ORACLES) == {"fleet_report"}
