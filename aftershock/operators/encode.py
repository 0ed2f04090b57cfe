"""Dense ids for text values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.operators.ordered import WINDOW_ROWS, row_numbers
from aftershock.operators.sized import join_sized


def fit_ids(df: DataFrame, column: str, name: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """Table (value, id): ids from 0 in alphabetical order.

    The values are de-duplicated map-side and numbered range by range, so the
    dictionary may be larger than one task.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return row_numbers(values, [], [column], name, limit)


def apply_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Adds fitted ids; a value that was not fitted gets null."""
    return join_sized(df, ids, column, "left")


def ordinal_encode(df: DataFrame, column: str, name: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """Fits ids on a table and applies them to it."""
    return apply_ids(df, fit_ids(df, column, name, limit), column)
