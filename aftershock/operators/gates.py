"""Row filters and data-quality gates.

A gate that rejects rows offers two frames: what passes and what does not,
the latter with a reason.  Counting is left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.operators.sized import join_sized
from aftershock.settings import PRECISION_RANGE, RECALL_RANGE


def macro_filter(releases: DataFrame, currency: str) -> DataFrame:
    """Releases that carry a forecast, of one currency."""
    return releases.filter(F.col("forecast").isNotNull() & (F.col("country") == currency))


def null_columns(columns: Iterable[str]) -> Column:
    """Names of the columns that are null in a row, joined by commas."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def null_row_gate(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls, and the others with the names of their null columns."""
    columns = list(columns or df.columns)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.filter(~any_null), df.filter(any_null).withColumn("reason", null_columns(columns))


def parse_error_gate(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose score could be read, and those whose could not."""
    return df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull())


def week_coverage(
    df: DataFrame, expected: int, exempt: Sequence[int] = (), year: str = "year", week: str = "week"
) -> DataFrame:
    """Distinct weeks of every year and whether the year may be used."""
    weeks = df.groupBy(year).agg(F.countDistinct(week).alias("weeks"))
    return weeks.withColumn("complete", (F.col("weeks") == expected) | F.col(year).isin(*exempt))


def week_coverage_gate(
    df: DataFrame, expected: int, exempt: Sequence[int] = (), year: str = "year", week: str = "week"
) -> DataFrame:
    """Rows of the years that have the expected number of weeks."""
    good = week_coverage(df, expected, exempt, year, week).filter("complete").select(year)
    return join_sized(df, good, year, "left_semi")


def market_gap_audit(features: DataFrame, column: str) -> DataFrame:
    """Rows for which the market has no data; the table itself keeps them."""
    return features.filter(F.col(column).isNull())


def impact_filter(df: DataFrame, impact: str) -> DataFrame:
    """Rows of one impact, or all of them for ``ALL``."""
    return df if impact == "ALL" else df.filter(F.col("impact") == impact)


def isolated_only(bundles: DataFrame, count: str = "num_news") -> DataFrame:
    """Bundles of exactly one release."""
    return bundles.filter(F.col(count) == 1)


def indicator_lookup(
    df: DataFrame, indicator: str | None = None, instant: str | None = None, year: int | None = None
) -> DataFrame:
    """Rows of an indicator, an instant, a year, or any mix of them."""
    if indicator is not None:
        df = df.filter(F.col("indicator") == indicator)
    if instant is not None:
        df = df.filter(F.col("datetime") == F.lit(instant).cast("timestamp"))
    if year is not None:
        df = df.filter(F.year("datetime") == year)
    return df


def score_range_filter(
    results: DataFrame,
    precision: tuple[float, float] = PRECISION_RANGE,
    recall: tuple[float, float] = RECALL_RANGE,
    model_type: str | None = None,
    sweeps: Sequence[str] | None = None,
) -> DataFrame:
    """Results whose precision and recall above the threshold lie in a range."""
    out = results.filter(
        F.col("precision_above_TH").between(*precision) & F.col("recall_above_TH").between(*recall)
    )
    if model_type is not None:
        out = out.filter(F.col("model_type") == model_type)
    if sweeps is not None:
        out = out.filter(F.col("sweep_news_agg").isin(*sweeps))
    return out


def view_filters(
    df: DataFrame, window: int, impacts: Sequence[str], months: tuple[int, int]
) -> DataFrame:
    """The dashboard's filter on horizon, impact and month."""
    return df.filter(
        (F.col("window") == window)
        & F.col("impact").isin(*impacts)
        & F.col("month").between(*months)
    )


def extreme_filter(df: DataFrame, column: str, above: float = 15.0) -> DataFrame:
    """Rows whose score exceeds a bound."""
    return df.filter(F.col(column) > above)


def skip_empty_rows(rows: DataFrame, column: str) -> DataFrame:
    """Page rows that carry an event."""
    return rows.filter(F.col(column) != "")
