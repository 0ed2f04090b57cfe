"""Calendar files: reading, writing by year, rows that cannot be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.functions.flags import first_word, provider_flag_map
from aftershock.schemas import CALENDAR_FILE, PROVIDER_FILE


def scan_calendar(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = CALENDAR_FILE
) -> DataFrame:
    """All yearly calendar files in one read.

    ``file_year`` is the year in the file name, or of the row where the name
    has none.  The row number column becomes, with the year, the ``event_id``
    that orders releases of the same instant.
    """
    raw = spark.read.schema(schema).option("header", True).csv(paths)
    out = raw.withColumn("file_year", F.coalesce(_year_of_file(), F.year("datetime")))
    if "row_no" in raw.columns:
        out = out.withColumn("event_id", _event_id(F.col("file_year"))).drop("row_no")
    return out.withColumnRenamed("new", "indicator") if "new" in raw.columns else out


def _year_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})\.csv", 1).try_cast("int")


def _event_id(year: Column) -> Column:
    """Year and row number in one number; a file may hold 2**40 rows."""
    return F.shiftleft(year.cast("bigint"), 40) + F.col("row_no")


def scan_provider(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files of the second provider, brought to the columns of the first."""
    raw = spark.read.schema(PROVIDER_FILE).option("header", True).csv(paths)
    day = F.regexp_replace("date", r"^[A-Za-z]+, *", "")
    year = F.regexp_extract("date", r"(\d{4})$", 1).try_cast("int")
    return raw.select(
        _event_id(F.coalesce(_year_of_file(), year)).alias("event_id"),
        F.try_to_timestamp(F.concat_ws(" ", day, "time"), F.lit("MMMM d, yyyy HH:mm")).alias("datetime"),
        F.col("new").alias("indicator"),
        F.coalesce("country", first_word(F.col("new"))).alias("country"),
        "impact",
        "actual",
        "forecast",
        "previous",
        provider_flag_map(F.col("forecast_error")).alias("forecast_error"),
        provider_flag_map(F.col("previous_error")).alias("previous_error"),
    )


def split_rejects(
    df: DataFrame, checks: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the failed checks as ``reason``."""
    reason = F.concat_ws(
        ",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    )
    marked = df.withColumn("reason", reason)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def sink_rejects(rejects: DataFrame, path: str) -> None:
    """Appends rejected rows to the error table."""
    rejects.write.mode("append").parquet(path)


def sink_calendar_by_year(releases: DataFrame, path: str, ts: str = "datetime") -> None:
    """Writes calendar rows by the year they happened in."""
    releases.withColumn("year", F.year(ts)).write.mode("overwrite").partitionBy("year").option(
        "header", True
    ).csv(path)
