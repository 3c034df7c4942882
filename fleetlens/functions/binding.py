"""Evaluate an expression once and refer to it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time per row.

    Inside higher-order functions Spark has no common-subexpression
    elimination, so a regex used six times runs six times.  A one-element
    ``transform`` binds it to a lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]
