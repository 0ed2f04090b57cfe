"""Row order inside a key without holding the key in one task.

A plain window puts all rows of a key into one task, which is right for keys
of moderate size and wrong for one currency pair or one indicator that holds a
large part of the table.  The helpers here look at the largest key first (one
pre-aggregated job that returns one number) and, beyond a limit, split the key
by its own sort order:

* ``running_total`` / ``row_numbers``: range partitioning cuts long keys into
  ranges, every range is summed up, and the sums of earlier ranges are added.
* ``with_halo``: numbered rows are laid out in chunks of bounded size that
  carry copies of the neighbour rows their frames reach for.
* ``with_frames``: Window columns with bounded frames over any of the two.

Window columns are given as SQL text over a window text ``w``, for instance
``lag(actual) OVER (w)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aftershock.operators.sized import join_null_safe
from aftershock.session import stored

# Most rows of one key that one window task may sort.
WINDOW_ROWS = 1_000_000
# Rows of a chunk when a key is split.
CHUNK_ROWS = 65_536


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the most frequent key (all rows when there is no key)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    name: str,
    limit: int = WINDOW_ROWS,
    longest: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same key.

    ``order`` must be unique inside a key.  ``longest`` is the size of the
    largest key when it is known already.  ``total`` names a further column
    with the sum over the whole key.
    """
    longest = largest_group(df, keys) if longest is None else longest
    if longest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        out = {name: _before(weight, w)}
        if total is not None:
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out[total] = F.sum(weight).over(whole)
        return df.withColumns(out)

    ranged = _in_ranges(df.withColumn("_weight", weight), keys, order, limit)
    # A key meets at most ``parts`` ranges, so these windows stay small.
    by_range = Window.partitionBy(*keys).orderBy("_range")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_weight").alias("_sum"))
    sums = sums.withColumns(
        {"_earlier": _before(F.col("_sum"), by_range), "_total": F.sum("_sum").over(whole)}
    ).drop("_sum")
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    inside = ranged.withColumn("_inside", _before(F.col("_weight"), w))
    out = join_null_safe(inside, sums, [*keys, "_range"]).withColumn(
        name, F.col("_inside") + F.col("_earlier")
    )
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_weight", "_range", "_inside", "_earlier", "_total")


def _in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Rows with ``_range``, the number of their part of the table in key and row order; stored.

    Ranges hold about ``limit`` rows at most, also of one key.
    """
    shuffle_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle_parts, 2 * df.count() // limit)
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    return stored(ranged, "ranges")


def last_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    limit: int = WINDOW_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Sets columns to the last value that is not null, of the row itself or an earlier one of its key.

    Null keys are a key of their own; ``order`` must be unique inside a key.  Long
    keys are scanned in two levels: every range has its last values, and each
    range begins with those that the ranges before it leave.
    """
    keys, order = list(keys), list(order)
    longest = largest_group(df, keys) if longest is None else longest
    if longest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in values.items()})
    named = {f"_value{i}": v for i, v in enumerate(values.values())}
    ranged = _in_ranges(df.withColumns(named), keys, order, limit)
    # A struct is never null, so rows without an order count too.
    place = F.struct(*order)
    ends = ranged.groupBy(*keys, "_range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in named]
    )
    # A key meets as many ranges as there are, so these windows stay small.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select(
        *keys, "_range", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_before{c}") for c in named]
    )
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in named})
    joined = join_null_safe(inside, left, [*keys, "_range"])
    filled = {c: F.coalesce(n, f"_before{n}") for c, n in zip(values, named, strict=True)}
    return joined.withColumns(filled).select(*df.columns)


def running_min(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    limit: int = WINDOW_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Smallest ``value`` of the row itself and the earlier rows of its key, in two levels for long keys."""
    keys, order = list(keys), list(order)
    longest = largest_group(df, keys) if longest is None else longest
    if longest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.min(value).over(w))
    ranged = _in_ranges(df.withColumn("_value", value), keys, order, limit)
    least = ranged.groupBy(*keys, "_range").agg(F.min("_value").alias("_least"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*keys, "_range", F.min("_least").over(earlier).alias("_before"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_inside", F.min("_value").over(w))
    joined = join_null_safe(inside, least, [*keys, "_range"])
    return joined.withColumn(name, F.least("_inside", "_before")).select(*df.columns, name)


def _before(weight: Column, w: WindowSpec) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(frame), F.lit(0))


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "_n",
    limit: int = WINDOW_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Position of every row inside its key, from 0."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, limit, longest)


def with_halo(
    df: DataFrame, position: str, before: int, after: int, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Numbered rows in chunks, each with the neighbours its frames reach.

    Adds ``_chunk`` and ``_own``; rows with ``_own`` false are copies.
    """
    p = F.col(position)
    first = F.greatest(F.floor((p - after) / chunk), F.lit(0))
    last = F.floor((p + before) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == F.floor(p / chunk)
    )


def window_text(keys: Sequence[str], order: Sequence[str]) -> str:
    """``PARTITION BY ... ORDER BY ...`` of the given columns."""
    by = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return f"{by}ORDER BY {', '.join(f'`{c}`' for c in order)}"


def framed(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: Callable[[str], dict[str, str]],
    before: int,
    after: int,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns over numbered rows; no frame may reach further than given.

    All columns share one exchange and one sort.
    """
    texts = columns(window_text([*keys, "_chunk"], [position]))
    return (
        with_halo(df, position, before, after, chunk)
        .selectExpr("*", *[f"{text} AS `{name}`" for name, text in texts.items()])
        .filter("_own")
        .drop("_chunk", "_own")
    )


def with_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Callable[[str], dict[str, str]],
    before: int = 0,
    after: int = 0,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Window columns over bounded frames, whatever the size of the largest key."""
    longest = largest_group(df, keys) if longest is None else longest
    if longest <= limit:
        texts = columns(window_text(keys, order))
        return df.selectExpr("*", *[f"{text} AS `{name}`" for name, text in texts.items()])
    numbered = row_numbers(df, keys, order, "_n", limit, longest)
    return framed(numbered, keys, "_n", columns, before, after, chunk).drop("_n")
