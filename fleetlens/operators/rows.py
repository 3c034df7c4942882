"""Row filters and latest-row selection shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_nulls(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows without NULL in any of the columns.

    Written as separate IS NOT NULL conditions: they push down to the scan one by
    one, and the optimizer's constraint propagation stays linear (the single
    condition of ``dropna`` doubles with every renamed column).
    """
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return rows.filter(condition)
