"""Joins of releases to the market.

All are equi joins on an instant, and on the pair where releases have a
``pair`` column.  Releases without one need a market of a single pair.  Many
releases share an instant, so market rows are brought to one row per distinct
instant first and the join to the releases comes last, by ``join_sized``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.moments import minutes, round_to_candle, shift_minutes
from aftershock.operators.market import PRICES
from aftershock.operators.sized import join_sized
from aftershock.settings import CANDLE_MINUTES, SNAPSHOT_ENDS


def instant_keys(releases: DataFrame, market: DataFrame) -> list[str]:
    """Join keys of releases and a market table.

    Raises if the releases name no pair while the market has several.
    """
    if "pair" in releases.columns:
        return ["pair", "datetime_gmt"]
    if "pair" in market.columns and len(market.select("pair").distinct().take(2)) > 1:
        raise ValueError("the market has several pairs: give the releases a pair, or choose one")
    return ["datetime_gmt"]


def join_release_candle(releases: DataFrame, candles: DataFrame) -> DataFrame:
    """The candle that closes at the release, as ``*_released``."""
    keys = instant_keys(releases, candles)
    released = candles.withColumn("datetime_gmt", shift_minutes(F.col("ts"), CANDLE_MINUTES))
    # Only candles of wanted instants are measured and joined.
    released = released.join(releases.select(*keys).distinct(), keys, "leftsemi").select(
        *keys, *[F.col(c).alias(f"{c}_released") for c in PRICES]
    )
    return join_sized(releases, released, keys, "left")


def snapshot_suffix(end: int) -> str:
    return f"_{end - CANDLE_MINUTES}_{end}_after"


def snapshot_columns(end: int) -> dict[str, str]:
    """Metrics of one five-minute candle; pips_agg counts from the release candle."""
    s = snapshot_suffix(end)
    o, h, lo, c = (f"_{price}_{end}" for price in PRICES)
    return {
        "high" + s: h,
        "low" + s: lo,
        "close" + s: c,
        "volatility" + s: f"abs({h} - {lo})",
        "pips_agg" + s: f"{c} - close_released",
        "pips_candle" + s: f"{c} - {o}",
    }


def market_by_instant(
    instants: DataFrame,
    market: DataFrame,
    snapshot_ends: Sequence[int] = SNAPSHOT_ENDS,
    features_at: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct instant (of a pair, if there are pairs) with all market columns.

    Release candle and snapshots are looked up by a single equi join over
    exploded offsets that carries prices only; the features of the candle at
    the release join once.  ``market`` is a candle table with any feature columns;
    or ``features_at`` has the features of the instants' candles (pair, ts, ...).
    """
    keys = instant_keys(instants, market)
    at_ts = [*keys[:-1], "ts"]
    features_at = market if features_at is None else features_at
    features = [c for c in features_at.columns if c not in ("pair", "ts", "candle_no", *PRICES)]
    offsets = sorted({-CANDLE_MINUTES, *[e - CANDLE_MINUTES for e in snapshot_ends]})
    wanted = instants.select(*keys).distinct().withColumn(
        "_off", F.explode(F.array(*[F.lit(o) for o in offsets]))
    )
    wanted = wanted.withColumn(
        "ts", round_to_candle(F.col("datetime_gmt") + minutes(F.col("_off")))
    )
    # Only candles of wanted instants are shuffled.
    near = join_sized(market.select(*at_ts, *PRICES), wanted.select(*at_ts).distinct(), at_ts, "leftsemi")
    looked_up = wanted.join(near, at_ts, "left")

    def at(offset: int, column: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN _off = {offset} THEN {column} END) AS {name}")

    aggs = [at(-CANDLE_MINUTES, c, f"{c}_released") for c in PRICES]
    for end in snapshot_ends:
        aggs += [at(end - CANDLE_MINUTES, c, f"_{c}_{end}") for c in PRICES]
    found = looked_up.groupBy(*keys).agg(*aggs)
    if features:
        at_release = features_at.withColumnRenamed("ts", "datetime_gmt").select(*keys, *features)
        found = found.join(at_release, keys, "left")
    texts: dict[str, str] = {}
    for end in snapshot_ends:
        texts.update(snapshot_columns(end))
    return found.selectExpr(
        *keys,
        *features,
        *[f"{c}_released" for c in PRICES],
        *[f"{text} AS {name}" for name, text in texts.items()],
    )


def join_snapshots_5m(
    releases: DataFrame, candles: DataFrame, snapshot_ends: Sequence[int] = SNAPSHOT_ENDS
) -> DataFrame:
    """Releases with the release candle and the five-minute snapshots after it."""
    prices = candles.select("pair", "ts", *PRICES)
    return join_market(releases, market_by_instant(releases, prices, snapshot_ends))


def join_market(releases: DataFrame, by_instant: DataFrame) -> DataFrame:
    """Left join of releases to one market row per instant, and pair if there are pairs."""
    return join_sized(releases, by_instant, instant_keys(releases, by_instant), "left")


def join_candle_features(releases: DataFrame, features: DataFrame) -> DataFrame:
    """Left join to features of the candle that starts at the release."""
    keys = instant_keys(releases, features)
    drop = [c for c in ("candle_no", *PRICES, *(["pair"] if "pair" not in keys else []))]
    market = features.drop(*drop).withColumnRenamed("ts", "datetime_gmt")
    market = market.join(releases.select(*keys).distinct(), keys, "leftsemi")
    return join_sized(releases, market, keys, "left")


def join_bundle_market(bundles: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bundles with the market columns of their instant.

    Releases of one instant repeat the same market row, so exact duplicates go
    first.
    """
    market = features.select("datetime", *columns).dropDuplicates()
    return bundles.join(market, "datetime", "left")


def join_predictions(features: DataFrame, predictions: DataFrame, on: str = "datetime") -> DataFrame:
    """All features with the predictions there are; rows that were not scored stay null."""
    return join_sized(features, predictions, on, "left")


def join_news_windows(releases: DataFrame, windows: DataFrame, on: str = "datetime") -> DataFrame:
    """Releases with one row per horizon of their instant."""
    return join_sized(releases, windows, on, "left")
