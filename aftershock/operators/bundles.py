"""Releases that appear at the same instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.operators.ordered import WINDOW_ROWS, row_numbers
from aftershock.settings import IMPACTS


def bundle_rows(
    releases: DataFrame, order: Sequence[str] = ("event_id",), limit: int = WINDOW_ROWS
) -> DataFrame:
    """Releases with their position inside their instant, from 0: bundles of any size."""
    return row_numbers(releases, ["datetime"], order, "position", limit)


def bundle_lists(
    releases: DataFrame,
    columns: Sequence[str],
    first: Sequence[str] = (),
    order: Sequence[str] = ("event_id",),
    *,
    part_rows: int,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Lists of every column per instant, all in the same order.

    A bundle continues in a further part after ``part_rows`` releases, which the
    caller chooses, so that no list outgrows a row; parts count from 0.
    """
    numbered = bundle_rows(releases, order, limit).withColumnRenamed("position", "_n")
    entry = F.struct("_n", *dict.fromkeys([*columns, *first]))
    lists = (
        numbered.withColumn("part", F.floor(F.col("_n") / part_rows))
        .groupBy("datetime", "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    )
    return lists.select(
        "datetime",
        "part",
        F.size("_rows").alias("rows"),
        *[F.col(f"_rows.{c}").alias(c) for c in columns],
        *[F.col("_rows")[0][c].alias(f"first_{c}") for c in first],
    )


def bundle_key(
    releases: DataFrame,
    column: str,
    name: str = "new_id",
    order: Sequence[str] = ("event_id",),
    *,
    part_rows: int,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Values of a column per instant and part, joined by ``_``."""
    text = releases.withColumn(name, F.col(column).cast("string"))
    lists = bundle_lists(text, [name], (), order, part_rows=part_rows, limit=limit)
    return lists.select("datetime", "part", F.array_join(name, "_").alias(name))


def bundle_count(releases: DataFrame, name: str = "num_news") -> DataFrame:
    """Number of releases per instant."""
    return releases.groupBy("datetime").agg(F.count(F.lit(1)).alias(name))


def impact_counts(impacts: Sequence[str] = IMPACTS) -> list[Column]:
    """Number of releases of each impact, as aggregates."""
    return [F.count_if(F.col("impact") == i).alias(i) for i in impacts]


def impact_weight(weights: Sequence[int]) -> Column:
    """Weight of a release by its impact, from (high, medium, low) weights."""
    out = F.lit(0)
    for impact, weight in zip(IMPACTS, weights, strict=True):
        out = F.when(F.col("impact") == impact, F.lit(weight)).otherwise(out)
    return out


def weighted_bundle_sum(column: str, weights: Sequence[int] | None) -> Column:
    """Sum of a column over a bundle, weighted by impact; plain without weights.

    A plain aggregate: partial sums combine map-side, so a hot instant moves
    one row per task.
    """
    value = F.col(column)
    total = F.sum(value if weights is None else value * impact_weight(weights))
    return F.round(total, 2).alias(column)


def first_of(column: str, order: str = "event_id") -> Column:
    """First non-null value in a fixed order, as an aggregate."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def first_per_key(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = "event_id"
) -> DataFrame:
    """One row per key with the first non-null value of every column."""
    return df.groupBy(*keys).agg(*[first_of(c, order) for c in columns])


def bundle_summary(
    features: DataFrame,
    total: str,
    pips: Sequence[str],
    key: str = "datetime_gmt",
    order: str = "event_id",
) -> DataFrame:
    """Sum of a score, count of releases and first pips value per instant."""
    return features.groupBy(key).agg(
        F.round(F.sum(total), 2).alias(total),
        F.count(F.lit(1)).alias("num_news"),
        *[first_of(c, order) for c in pips],
    )
