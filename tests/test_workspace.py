"""Staged data goes to a shared folder or nowhere."""

import pytest

from fleetlens.sources.workspace import SHARED, ensure_shared, workspace


class _Conf(dict):
    set = dict.__setitem__


class _Session:
    def __init__(self, **settings):
        self.conf = _Conf({k.replace("__", "."): v for k, v in settings.items()})


def test_an_unconfigured_session_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace(_Session(), "reports")


def test_the_configured_folder_wins():
    session = _Session(spark__checkpoint__dir="hdfs://x/shared/", spark__sql__warehouse__dir="hdfs://x/warehouse")
    ensure_shared(session)
    assert SHARED not in session.conf
    first, second = workspace(session, "a"), workspace(session, "a")
    assert first.startswith("hdfs://x/shared/fleetlens-a-") and first != second


def test_entry_points_fall_back_to_the_warehouse():
    session = _Session(spark__sql__warehouse__dir="hdfs://x/warehouse/")
    ensure_shared(session)
    assert workspace(session, "a").startswith("hdfs://x/warehouse/_shared/fleetlens-a-")
