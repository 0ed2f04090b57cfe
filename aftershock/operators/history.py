"""A release against the history of its own indicator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.numbers import outlier_category, safe_ratio, signed_surprise
from aftershock.functions.prices import two_decimals
from aftershock.operators.ordered import CHUNK_ROWS, WINDOW_ROWS, with_frames
from aftershock.operators.quartiles import expanding_quartiles
from aftershock.settings import HISTORY_ROWS

INDICATOR = ("indicator",)
ORDER = ("datetime_gmt", "event_id")


def previous_value(
    releases: DataFrame,
    keys: Sequence[str] = INDICATOR,
    order: Sequence[str] = ORDER,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Actual value of the indicator's last release; the first uses its own ``previous``."""

    def columns(w: str) -> dict[str, str]:
        return {"previous_value": f"coalesce(lag(actual) OVER ({w}), previous)"}

    return with_frames(releases, keys, order, columns, 1, 0, limit, chunk, longest)


def revision_surprise(
    releases: DataFrame,
    keys: Sequence[str] = INDICATOR,
    order: Sequence[str] = ORDER,
    invalid: float | None = None,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """How far the published previous value was revised, and the total surprise."""
    revised = signed_surprise(
        F.col("previous_value"), F.col("previous"), F.col("previous_error"), invalid
    )
    return (
        previous_value(releases, keys, order, limit, chunk, longest)
        .withColumn("previous_error_diff", revised)
        .withColumn("total_error_diff", F.col("forecast_error_diff") + F.col("previous_error_diff"))
    )


def rolling_columns(w: str, field: str, size: int = HISTORY_ROWS) -> dict[str, str]:
    """Deviation and mean of the ``size`` earlier values, own value when there are fewer."""
    frame = f"OVER ({w} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    value = f"CAST({field} AS DOUBLE)"
    full = f"count({field}) {frame} = {size}"
    return {
        f"{field}_std": f"CASE WHEN {full} THEN stddev_samp({value}) {frame} ELSE {value} END",
        f"{field}_mean": f"CASE WHEN {full} THEN avg({value}) {frame} ELSE {value} END",
    }


def rolling_std_mean(
    df: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = INDICATOR,
    order: Sequence[str] = ORDER,
    size: int = HISTORY_ROWS,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Rolling deviation and mean of several fields in one sort."""

    def columns(w: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for field in fields:
            out.update(rolling_columns(w, field, size))
        return out

    return with_frames(df, keys, order, columns, size, 0, limit, chunk, longest)


def deviation_score(
    df: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = INDICATOR,
    order: Sequence[str] = ORDER,
    size: int = HISTORY_ROWS,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Ratio of every value to the recent spread of its indicator."""
    rolled = rolling_std_mean(df, fields, keys, order, size, limit, chunk, longest)
    for field in fields:
        ratio = safe_ratio(
            F.col(field).cast("double"), F.col(f"{field}_std"), F.col(f"{field}_mean")
        )
        rolled = rolled.withColumn(f"{field}_deviation", two_decimals(ratio))
    return rolled.drop(*[f"{f}_{part}" for f in fields for part in ("std", "mean")])


def outlier_score(
    df: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = INDICATOR,
    order: Sequence[str] = ORDER,
    size: int = HISTORY_ROWS,
    limit: int = WINDOW_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Outlier class of every value against all earlier values of its indicator."""
    out = expanding_quartiles(df, fields, keys, order, size, limit=limit, longest=longest)
    for field in fields:
        category = outlier_category(
            F.col(field).cast("double"), F.col(f"{field}_q1"), F.col(f"{field}_q3")
        )
        out = out.withColumn(f"{field}_outlier_class", category)
    return out.drop(*[f"{f}_{q}" for f in fields for q in ("q1", "q3")])
