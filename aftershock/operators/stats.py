"""Profile statistics.

Exact order statistics are selected by narrowing (see ``selection``), all else is
plain aggregates; no task sees the raw rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.operators.ordered import WINDOW_ROWS, last_values
from aftershock.operators.selection import COLUMNS_AT_ONCE, order_statistics
from aftershock.operators.sized import join_sized
from aftershock.session import stored

# Correlations that one aggregate computes.
PAIRS_AT_ONCE = 26


def row_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Number of rows that meet each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def count_by_key(df: DataFrame, keys: Sequence[str], name: str = "rows") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_per_impact(df: DataFrame, column: str = "indicator") -> DataFrame:
    """Number of distinct values of a column per impact."""
    return df.groupBy("impact").agg(F.countDistinct(column).alias("distinct_values"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column."""
    return df.select(column).distinct()


def share_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and their share of all rows in percent."""
    counts = count_by_key(df, [key])
    total = counts.agg(F.sum("rows").alias("_all")).scalar()
    return counts.withColumn("share", F.round(F.col("rows") * 100.0 / total, 6))


def bundle_rate(counts: DataFrame, name: str = "num_news") -> DataFrame:
    """Share of instants with several releases and with one, in percent."""
    several = F.count_if(F.col(name) > 1)
    return counts.agg(
        F.count(F.lit(1)).alias("instants"),
        F.round(several * 100.0 / F.count(F.lit(1)), 6).alias("bundled_pct"),
        F.round(F.count_if(F.col(name) == 1) * 100.0 / F.count(F.lit(1)), 6).alias("isolated_pct"),
    )


def mean_by_key(df: DataFrame, keys: Sequence[str], column: str, name: str = "mean") -> DataFrame:
    """Mean of a column per key."""
    return df.groupBy(*keys).agg(F.round(F.avg(column), 6).alias(name))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every value of several text columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("_p"))
        .select("_p.*")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and non-null counts of every column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("_all") - F.col(f"_{i}")).alias("nulls"),
            F.col(f"_{i}").alias("non_nulls"),
        )
        for i, c in enumerate(columns)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: dict[str, float],
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Percentiles of ``value`` per key, linear between two ranks."""
    return order_statistics(df, keys, [value], shares, limit).drop("column", "count")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_stats(
    df: DataFrame, columns: Sequence[str], limit: int = WINDOW_ROWS
) -> DataFrame:
    """count, mean, std, min, quartiles and max of several columns.

    The columns stay side by side: a bounded number of them is aggregated at a
    time, and no row is made for each value.
    """
    columns = list(columns)
    rows = stored(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "described")
    plain = None
    for start in range(0, len(columns), COLUMNS_AT_ONCE):
        cells = []
        for c in columns[start : start + COLUMNS_AT_ONCE]:
            cells.append(
                F.struct(
                    F.lit(c).alias("column"), F.round(F.avg(c), 6).alias("mean"),
                    F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                )
            )
        part = rows.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        plain = part if plain is None else plain.unionByName(part)
    ranks = order_statistics(rows, [], columns, QUARTILES, limit)
    # One row for each column.
    return ranks.join(F.broadcast(plain), "column").select(
        "column", "count", "mean", "std", "min", "max", *[F.round(q, 6).alias(q) for q in QUARTILES]
    )


def horizon_thresholds(
    long: DataFrame, value: str, share: float = 0.75, limit: int = WINDOW_ROWS
) -> DataFrame:
    """Percentile of the reaction per horizon, from the long table."""
    return exact_percentiles(long, ["from_min", "to_min"], value, {"threshold": share}, limit)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from minimum to maximum; the last bin is closed."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    low = bounds.select("lo").scalar()
    high = bounds.select("hi").scalar()
    place = F.floor((x - low) * F.lit(float(bins)) / (high - low))
    bin_no = F.when(high == low, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(bin_no.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def box_stats(
    df: DataFrame, keys: Sequence[str], column: str, limit: int = WINDOW_ROWS
) -> DataFrame:
    """Median, quartiles and whiskers at 1.5 IQR per key."""
    keys = list(keys)
    value = F.col("_value")
    rows = df.select(*keys, F.col(column).cast("double").alias("_value")).filter(value.isNotNull())
    rows = stored(rows, "boxed")
    boxes = order_statistics(rows, keys, ["_value"], QUARTILES, limit).drop("column", "count")
    iqr = F.col("q3") - F.col("q1")
    inside = value.between(F.col("q1") - iqr * 1.5, F.col("q3") + iqr * 1.5)
    return (
        join_sized(rows, boxes, keys, null_safe=True)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns.

    Plain aggregates over the stored columns, a bounded number of pairs at a
    time, which keeps the generated code small.  A pair counts the rows where
    both values are present.
    """
    rows = stored(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "correlated")
    pairs = list(combinations(columns, 2))
    out = None
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        cells = []
        for a, b in pairs[start : start + PAIRS_AT_ONCE]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            corr = F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(corr, 6).alias("corr")))
        part = rows.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        out = part if out is None else out.unionByName(part)
    return out


def scatter_pairs(
    df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Points of every pair of columns with the correlation of the pair."""
    points = [
        F.struct(
            F.lit(f"{a}~{b}").alias("pair"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for a, b in pairs
    ]
    long = (
        df.select(key, F.explode(F.array(*points)).alias("_p"))
        .select(key, "_p.*")
        .filter("x is not null and y is not null")
    )
    corr = long.groupBy("pair").agg(F.round(F.corr("x", "y"), 6).alias("corr"))
    # one row per given pair
    return long.join(F.broadcast(corr), "pair")


def cell_average(df: DataFrame, keys: Sequence[str], column: str, name: str = "cell_avg") -> DataFrame:
    """Points beside the average of their cell.

    The averages are aggregated first and joined back: a window over a cell
    would put all its points into one task.
    """
    if not keys:
        average = df.agg(F.round(F.avg(column), 6).alias(name)).scalar()
        return df.withColumn(name, average)
    cells = df.groupBy(*keys).agg(F.round(F.avg(column), 6).alias(name))
    return join_sized(df, cells, list(keys), null_safe=True)


def top_counts(counts: DataFrame, n: int, count: str, tie: str) -> DataFrame:
    """The n largest counts."""
    return counts.orderBy(F.col(count).desc(), tie).limit(n)


def head_tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First and last n rows of a total order."""
    head = df.orderBy(*order).limit(n).withColumn("end", F.lit("head"))
    tail = df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("end", F.lit("tail"))
    return head.unionByName(tail)


def row_range(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 of a total order."""
    return df.orderBy(*order).offset(start).limit(stop - start)


def rank_by_sum(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with their sums, largest first."""
    sums = df.groupBy(key).agg(F.sum(column).alias("total"))
    return sums.orderBy(F.col("total").desc_nulls_last(), key)


def last_n_events(df: DataFrame, indicator: str, n: int) -> DataFrame:
    """All releases at the last n instants at which an indicator appeared."""
    instants = (
        df.filter(F.col("indicator") == indicator)
        .select("datetime")
        .distinct()
        .orderBy(F.col("datetime").desc())
        .limit(n)
    )
    # at most n rows
    return df.join(F.broadcast(instants), "datetime", "left_semi")


def week_numbering(df: DataFrame, ts: str) -> DataFrame:
    """Number of the week inside its year, counted over the weeks that occur.

    Weeks start on Sunday.  A year has at most 54 of them, so only the distinct
    weeks are ranked.
    """
    day = F.to_date(ts)
    start = F.date_sub(day, F.dayofweek(day) - 1)
    rows = df.withColumns({"year": F.year(ts), "week_start": start})
    weeks = rows.select("year", "week_start").distinct()
    numbered = weeks.withColumn(
        "week_no", F.dense_rank().over(Window.partitionBy("year").orderBy("week_start"))
    )
    return join_sized(rows, numbered, ["year", "week_start"], null_safe=True)


def forward_fill(
    rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], limit: int = WINDOW_ROWS
) -> DataFrame:
    """Empty cells take the last non-empty value above them, however long a page is."""
    values = {c: F.nullif(F.col(c), F.lit("")) for c in columns}
    return last_values(rows, keys, [order], values, limit)
