"""Bundles of all aggregations from one scan.

An aggregation is a filter on the impact, weights by impact, and whether bundles of
several releases count.  All of them are made of the same parts, one for each instant
and impact; these are summed once and combined for each aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.operators.bundles import impact_weight
from aftershock.operators.gates import impact_filter, isolated_only
from aftershock.settings import IMPACTS


def bundle_lattice(
    rows: DataFrame,
    sums: Sequence[str],
    firsts: Sequence[str] = (),
    keep: Sequence[str] = (),
    instant: str = "datetime",
    order: str = "event_id",
) -> DataFrame:
    """One row for each instant and impact: ``_n`` releases, sums, first values and kept columns.

    Partial results combine map-side.  ``keep`` names columns that are equal for
    all releases of an instant.  Null impacts are a part of their own.
    """
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_first_{c}") for c in firsts]
    return rows.groupBy(instant, "impact").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums], *first, *[F.max(c).alias(c) for c in keep]
    )


def _combined(weight: Column | None, sums: Sequence[str], impacts: Sequence[str], firsts: Sequence[str], keep: Sequence[str]):
    """Aggregates of a bundle over its parts."""

    def total(c: str) -> Column:
        return F.round(F.sum(F.col(c) if weight is None else F.col(c) * weight), 2).alias(c)

    return [
        F.sum("_n").alias("num_news"),
        *[total(c) for c in sums],
        *[F.sum(F.when(F.col("impact") == i, F.col("_n")).otherwise(0)).alias(i) for i in impacts],
        *[F.min(f"_first_{c}")[c].alias(c) for c in firsts],
        *[F.max(c).alias(c) for c in keep],
    ]


def bundles_of(
    lattice: DataFrame,
    impact: str,
    weights: Sequence[int],
    isolated: bool,
    sums: Sequence[str],
    firsts: Sequence[str] = (),
    keep: Sequence[str] = (),
    instant: str = "datetime",
) -> DataFrame:
    """Bundles of one aggregation; weights count for ``ALL`` impacts only."""
    parts = impact_filter(lattice, impact)
    weight = impact_weight(weights) if impact == "ALL" else None
    impacts = IMPACTS if impact == "ALL" else (impact,)
    bundles = parts.groupBy(instant).agg(*_combined(weight, sums, impacts, firsts, keep))
    return isolated_only(bundles) if isolated else bundles


def all_bundles(
    lattice: DataFrame,
    sums: Sequence[str],
    firsts: Sequence[str] = (),
    isolation: Sequence[str] = ("NO", "YES"),
    weights: Sequence[str] = ("1_1_1", "3_2_1"),
    instant: str = "datetime",
) -> DataFrame:
    """Bundles of every aggregation of the lattice's impacts, with their ``aggregation``, in one pass.

    Each part goes to the aggregations that it belongs to, at most four for its
    impact and four for all impacts, before the sums are shuffled.
    """
    each = []
    for text in weights:
        for alone in isolation:
            each.append(F.struct(F.concat_ws("_", F.lit("ALL"), F.lit(alone), F.lit(text)).alias("aggregation"),
                                 impact_weight([int(w) for w in text.split("_")]).alias("_weight")))
            own = F.struct(F.concat_ws("_", "impact", F.lit(alone), F.lit(text)).alias("aggregation"), F.lit(1).alias("_weight"))
            each.append(F.when(F.col("impact").isNotNull(), own))
    parts = lattice.withColumn("_a", F.explode(F.filter(F.array(*each), lambda a: a.isNotNull()))).select("*", "_a.*")
    bundles = parts.groupBy("aggregation", instant).agg(*_combined(F.col("_weight"), sums, IMPACTS, firsts, ()))
    return bundles.filter((F.col("num_news") == 1) | (F.split("aggregation", "_")[1] != "YES"))
