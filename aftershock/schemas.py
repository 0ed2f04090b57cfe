"""Explicit schemas of the files that are read."""

from pyspark.sql import types as T

# Columns of a calendar file, in file order (the first one is a row number).
CALENDAR_FILE = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("actual", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("forecast", T.StringType()),
        T.StructField("forecast_error", T.StringType()),
        T.StructField("impact", T.StringType()),
        T.StructField("new", T.StringType()),
        T.StructField("previous", T.StringType()),
        T.StructField("previous_error", T.StringType()),
        T.StructField("week", T.IntegerType()),
    ]
)

# Second calendar provider: date and time are text.
PROVIDER_FILE = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("actual", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("forecast", T.StringType()),
        T.StructField("forecast_error", T.StringType()),
        T.StructField("impact", T.StringType()),
        T.StructField("new", T.StringType()),
        T.StructField("previous", T.StringType()),
        T.StructField("previous_error", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)

CANDLE_FILE = T.StructType(
    [
        T.StructField("gmt_time", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# Table of sweep results; numbers stay numbers, text is made on export.
SWEEP_RESULT = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("sweeps_market_variables", T.StringType()),
        T.StructField("sweep_news_agg", T.StringType()),
        T.StructField("sweep_buy_sell", T.StringType()),
        T.StructField("before_data", T.StringType()),
        T.StructField("sweep_grid", T.StringType()),
        T.StructField("best_score", T.DoubleType()),
        T.StructField("best_params", T.StringType()),
        T.StructField("f1_microavg", T.DoubleType()),
        T.StructField("precision_weighted", T.DoubleType()),
        T.StructField("precision_below_TH", T.DoubleType()),
        T.StructField("recall_below_TH", T.DoubleType()),
        T.StructField("precision_above_TH", T.DoubleType()),
        T.StructField("recall_above_TH", T.DoubleType()),
        T.StructField("support_below_TH", T.DoubleType()),
        T.StructField("support_above_TH", T.DoubleType()),
        T.StructField("report", T.StringType()),
        T.StructField("elapsed_time", T.DoubleType()),
    ]
)
