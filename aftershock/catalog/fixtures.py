"""The given tables in the shapes the operators work on.

``releases``: events of type signup as calendar rows (``every_release``: all
events).  ``candles``: all other events folded into five-minute candles.  ``histories``: orders as many
indicators.  ``scores``: order lines as predictions of seven sweeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.functions.moments import floor_to_candle, minutes
from aftershock.operators.history import ORDER
from aftershock.operators.market import candles_from_ticks
from aftershock.plans.curation import clean_releases
from aftershock.session import stored
from aftershock.settings import CurationConfig

HISTORY_KEYS = ("indicator",)
HISTORY_ORDER = ("datetime_gmt", "release_id")
RELEASE_ORDER = ORDER
CONFIG = CurationConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less timestamps count as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_releases(table(spark, sf_dir, "events").filter("event_type = 'signup'"))


def every_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as calendar rows, for what needs no candles beside them."""
    return _as_releases(table(spark, sf_dir, "events"))


def every_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_releases(every_release(spark, sf_dir), CONFIG, gmt_input=True)


def _as_releases(events: DataFrame) -> DataFrame:
    rows = events.selectExpr(
        "*",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS level",
        "element_at(array('%', 'K', 'M', ''), CAST(user_id % 4 AS INT) + 1) AS unit",
        "date_trunc('hour', ts) + make_dt_interval(0, 0, IF(minute(ts) >= 30, 30, 0)) AS slot",
    )
    return rows.selectExpr(
        "event_id",
        "slot - make_dt_interval(0, 0, IF(event_id % 7 = 0, 1, 0)) AS datetime",
        "CAST((dayofmonth(ts) - 1) DIV 7 AS INT) + 1 AS week",
        "concat('IND_', user_id % 8) AS indicator",
        "IF(event_id % 5 = 0, 'EUR', 'USD') AS country",
        "element_at(array('High', 'Medium', 'Low'), CAST(user_id % 3 AS INT) + 1) AS impact",
        "concat(CAST(CAST(value AS DECIMAL(10, 2)) AS STRING), unit) AS actual",
        "IF(event_id % 9 = 0, NULL, concat(5 * level, unit)) AS forecast",
        "IF(event_id % 3 = 0, NULL, IF(value > 5 * level, 'better', 'worse')) AS forecast_error",
        "IF(event_id % 50 = 0, 'Pass', concat(4 * level, unit)) AS previous",
        "CASE event_id % 4 WHEN 0 THEN 'better' WHEN 1 THEN 'worse' END AS previous_error",
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases after filters, rounding and surprise; ``datetime`` counts as GMT."""
    return clean_releases(releases(spark, sf_dir), CONFIG, gmt_input=True)


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    return candles_from_ticks(
        ticks,
        pair=F.lit("ALL"),
        ts=F.col("ts"),
        slot=floor_to_candle(F.col("ts")),
        pips=F.rint(F.col("value") * 100).cast("bigint"),
    )


def stored_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles written once: numbering reads them twice, the ticks only once."""
    return stored(candles(spark, sf_dir), "candles")


def pair_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ticks as one sparse series per event type."""
    ticks = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    folded = candles_from_ticks(
        ticks,
        pair=F.col("event_type"),
        ts=F.col("ts"),
        slot=floor_to_candle(F.col("ts")),
        pips=F.rint(F.col("value") * 100).cast("bigint"),
    )
    return stored(folded, "candles")


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("release_id"),
        F.concat(F.lit("CUST_"), F.col("o_custkey").cast("string")).alias("indicator"),
        F.col("o_orderdate").alias("datetime_gmt"),
        (F.col("o_totalprice") - 150000).cast("decimal(14,2)").alias("v"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("sweep_id"),
        "l_orderkey",
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).alias("y"),
        F.when(F.col("l_discount") > 0.05, F.lit(1)).otherwise(F.lit(0)).alias("yhat"),
        F.col("l_quantity").alias("y_reg"),
        (F.col("l_discount") * 10 + 25.0).alias("yhat_reg"),
    )


def wall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with an hour, as raw calendar times over several years."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        (F.col("o_orderdate") + minutes(((F.col("o_orderkey") % 96) * 15).cast("int"))).alias("datetime"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
