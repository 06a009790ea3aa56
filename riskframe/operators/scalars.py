"""Attaching a global aggregate to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of ``one_row`` appended.

    ``one_row`` must be a global aggregate (``agg`` without grouping keys, or a
    ``limit(1)``): exactly one row by construction, so broadcasting it is a
    proven size bound and the join is a projection against one row -- it never
    pairs data rows with data rows.
    """
    return df.crossJoin(F.broadcast(one_row))
