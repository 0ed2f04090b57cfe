"""Feature, sweep and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.schemas import SWEEP_RESULT


def feature_table_name(currency: str, pair: str, first_year: int, last_year: int, prefix: str = "features") -> str:
    """Name of a feature table, built from the parameters of its run."""
    return f"{prefix}_news_{currency}_pair_{pair}_{first_year}_{last_year}"


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """Curated features."""
    return spark.read.parquet(path)


def sink_features(features: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Writes curated features by year, and as text when asked.

    The text is made from the written table, so features are computed once.
    """
    features.write.mode("overwrite").partitionBy("year").parquet(path)
    if csv_path is not None:
        written = features.sparkSession.read.parquet(path)
        sink_long_export(written.select(*features.columns), csv_path)


def sink_sweep_dataset(dataset: DataFrame, sweep_id: str, path: str) -> None:
    """Writes the training table of one sweep; a repeated sweep replaces its own part."""
    _replace_part(dataset.withColumn("sweep_id", F.lit(sweep_id)), path)


def sink_partial_results(results: DataFrame, path: str) -> None:
    """Writes results sweep by sweep, so that a crash loses none that are done."""
    _replace_part(results, path)


def _replace_part(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "sweep_id"
    ).parquet(path)


def sink_predictions(features: DataFrame, path: str) -> None:
    """Writes features with their predictions."""
    features.write.mode("overwrite").parquet(path)


def sink_long_export(df: DataFrame, path: str) -> None:
    """Text export for dashboards."""
    df.write.mode("overwrite").option("header", True).csv(path)


def sink_split_export(train: DataFrame, test: DataFrame, path: str) -> None:
    """Writes the two sides of a split."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")


def scan_union_results(spark: SparkSession, paths: Sequence[str], schema=SWEEP_RESULT) -> DataFrame:
    """Many result files as one table."""
    return spark.read.schema(schema).option("header", True).csv(list(paths))
