"""Tables behind the dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.numbers import error_score, predictable_flag
from aftershock.operators.bundles import first_of
from aftershock.operators.impact import join_news_windows
from aftershock.operators.reshape import LONG_METRICS, wide_to_long
from aftershock.settings import HORIZON_ENDS


def dashboard_long(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Release columns with one row per horizon of their instant."""
    pips = [f"{m}_0_{e}_after" for e in HORIZON_ENDS for m in LONG_METRICS]
    market = features.select("datetime", *pips).dropDuplicates()
    return join_news_windows(features.select(*columns), wide_to_long(market, ["datetime"]))


def predictability(features: DataFrame, impact: str | None = None) -> DataFrame:
    """Summed error score per instant, first pips, and whether the two agree."""
    rows = features if impact is None else features.filter(F.col("impact") == impact)
    score = error_score(F.col("forecast_error"), F.col("impact")) + error_score(
        F.col("previous_error"), F.col("impact")
    )
    pips = [f"pips_candle_max_0_{e}_after" for e in HORIZON_ENDS]
    sums = (
        rows.withColumn("total_error", score)
        .groupBy("datetime")
        .agg(F.sum("total_error").alias("total_error"), *[first_of(c) for c in pips])
    )
    flag = predictable_flag(F.col("total_error"), F.col("pips_candle_max_0_30_after"))
    return sums.withColumn("predictable", flag)
