"""Candle files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.market import candles_in_pips
from aftershock.schemas import CANDLE_FILE

TIME_FORMAT = "dd.MM.yyyy HH:mm:ss.SSS"


def scan_candles(spark: SparkSession, paths: str | Sequence[str], pair: str) -> DataFrame:
    """OHLC text files of one pair as integer pips; the volume is dropped.

    Columns go by position.  Times are GMT.  Zip archives cannot be split or
    read, so land them as gzip, plain text or Parquet.
    """
    raw = spark.read.schema(CANDLE_FILE).option("header", True).option("enforceSchema", True).csv(paths)
    candles = raw.select(
        F.lit(pair).alias("pair"),
        F.to_timestamp("gmt_time", TIME_FORMAT).alias("ts"),
        "open",
        "high",
        "low",
        "close",
    )
    return candles_in_pips(candles)
