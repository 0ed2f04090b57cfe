"""From calendar and candles to curated features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.flags import fill_category
from aftershock.functions.moments import apply_dst, date_parts, round_to_candle, to_gmt
from aftershock.functions.numbers import signed_surprise
from aftershock.operators.gates import macro_filter, null_row_gate, week_coverage_gate
from aftershock.operators.history import (
    INDICATOR,
    deviation_score,
    outlier_score,
    revision_surprise,
)
from aftershock.operators.impact import instant_keys, join_market, market_by_instant
from aftershock.operators.market import market_at, market_features
from aftershock.operators.ordered import largest_group
from aftershock.session import stored
from aftershock.settings import CurationConfig, horizons

SURPRISES = ("forecast_error_diff", "previous_error_diff", "total_error_diff")


def clean_releases(
    calendar: DataFrame, config: CurationConfig = CurationConfig(), gmt_input: bool = False
) -> DataFrame:
    """Filtered releases with GMT candle time, surprise and date parts.

    ``gmt_input`` says that ``datetime`` already is GMT.
    """
    rows = calendar
    if config.expected_weeks is not None:
        years = rows.withColumn("year", F.year("datetime"))
        rows = week_coverage_gate(years, config.expected_weeks, config.exempt_years).drop("year")
    rows = macro_filter(rows, config.currency).withColumns(
        {
            "forecast_error": fill_category(F.col("forecast_error")),
            "previous_error": fill_category(F.col("previous_error")),
        }
    )
    raw = F.col("datetime")
    if gmt_input:
        gmt, wall = raw, raw
    elif config.dst_correction:
        gmt, wall = to_gmt(raw), apply_dst(raw)
    else:
        gmt, wall = F.to_utc_timestamp(raw, "America/New_York"), raw
    rows = rows.withColumns({"datetime_gmt": round_to_candle(gmt), "datetime": wall})
    rows, _ = null_row_gate(rows)
    surprise = signed_surprise(F.col("forecast"), F.col("actual"), F.col("forecast_error"))
    return rows.withColumns({"forecast_error_diff": surprise, **date_parts(F.col("datetime"))})


def score_history(releases: DataFrame) -> DataFrame:
    """Revision, total surprise, and deviation and outlier class of all three."""
    longest = largest_group(releases, INDICATOR)
    scored = revision_surprise(releases, longest=longest)
    scored = deviation_score(scored, SURPRISES, longest=longest)
    return outlier_score(scored, SURPRISES, longest=longest)


def market_table(
    releases: DataFrame, candles: DataFrame, config: CurationConfig = CurationConfig()
) -> DataFrame:
    """All market columns, one row per distinct instant of the releases."""
    if config.pair is not None:
        candles = candles.filter(F.col("pair") == config.pair)
    pairs = horizons(config.starts, config.ends)
    if config.frame != "rows":
        market = market_features(
            candles, pairs, config.before_minutes, config.include_release_candle, config.frame
        )
        return market_by_instant(releases, market, config.snapshot_ends)
    keys = instant_keys(releases, candles)
    instants = releases.select(*keys[:-1], F.col("datetime_gmt").alias("ts"))
    if len(keys) == 1:  # a single pair
        instants = instants.withColumn("pair", candles.select("pair").limit(1).scalar())
    features = market_at(instants, candles, pairs, config.before_minutes, config.include_release_candle)
    return market_by_instant(releases, candles, config.snapshot_ends, features)


def curate(
    calendar: DataFrame,
    candles: DataFrame,
    config: CurationConfig = CurationConfig(),
    gmt_input: bool = False,
) -> DataFrame:
    """Curated features of all years.

    Cleaned releases are read by several steps, so they are written once.
    """
    releases = stored(clean_releases(calendar, config, gmt_input), "releases")
    return join_market(score_history(releases), market_table(releases, candles, config))
