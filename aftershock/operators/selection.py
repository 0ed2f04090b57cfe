"""Exact order statistics by narrowing.

A sketch of every column gives a narrow range of values around each wanted rank.
One pass counts the rows below each range, another takes only the rows inside the
ranges, counts them by value and finds the rank among these.  So the shuffle holds
one row per key and task, and the values inside the ranges, a few in ten thousand
of a large table, instead of every distinct value.

Sketches may err.  Whether a rank lies in its range is seen from the counts; if not,
that column of that key is counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.operators.ordered import WINDOW_ROWS, running_total
from aftershock.operators.sized import join_null_safe, join_sized
from aftershock.session import stored

# Ranks that a sketch may be off by are one in as many.
ACCURACY = 40_000
# Half the width of a range, as a share of the rows, and the least rows to use it for.
WIDTHS = ((0.0001, 20_000), (0.001, 2_000), (0.01, 200), (0.1, 20))
# Columns that one aggregate looks at.
COLUMNS_AT_ONCE = 16


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    shares: dict[str, float],
    limit: int = WINDOW_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Percentiles of several columns per key, linear between two ranks.

    Returns ``keys..., column, count`` and one column for each of ``shares``.
    Nulls do not count, NaN is larger than all other values; a column without
    values has no row for the key.  Null keys are a key of their own.
    """
    keys = list(keys)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = stored(rows, "selected")  # read some times
    out = None
    for start in range(0, len(columns), COLUMNS_AT_ONCE):
        places = list(range(start, min(start + COLUMNS_AT_ONCE, len(columns))))
        found = _selected(rows, keys, places, list(shares.values()), limit, accuracy)
        out = found if out is None else out.unionByName(found)
    names = F.array(*[F.lit(c) for c in columns])
    aggs = [F.max(F.when(F.col("_share") == i, F.col("_value"))).alias(n) for i, n in enumerate(shares)]
    wide = out.groupBy(*keys, "_column", "count").agg(*aggs)
    return wide.select(*keys, F.get(names, F.col("_column")).alias("column"), "count", *shares)


def _ranks(share: float) -> tuple[Column, Column]:
    """The two ranks that a percentile lies between."""
    place = F.lit(share) * (F.col("count") - 1)
    return F.floor(place), F.ceil(place)


def _selected(
    rows: DataFrame, keys: list[str], places: list[int], shares: list[float], limit: int, accuracy: int
) -> DataFrame:
    """``keys, _column, count, _share, _value`` of some columns."""
    known = stored(_sketched(rows, keys, places, shares, accuracy), "sketches")
    if keys:
        met = join_sized(rows, known, keys, null_safe=True)
    else:  # one row of a bounded number of values
        told = {c: F.lit(v).cast(kind) for (c, kind), v in zip(known.dtypes, known.first(), strict=True)}
        met = rows.withColumns(told)

    cells = [
        (i, j, F.col(f"_c{i}"), F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")) for i in places for j in range(len(shares))
    ]
    below = met.groupBy(*keys).agg(*[F.count_if(x < lo).alias(f"_b{i}_{j}") for i, j, x, lo, _ in cells])
    asked = [
        F.struct(
            F.lit(i).alias("_column"), F.lit(j).alias("_share"), F.col(f"_n{i}").alias("count"),
            F.col(f"_b{i}_{j}").alias("_below"),
        )
        for i, j, *_ in cells
    ]
    below = join_null_safe(below, known, keys) if keys else below.withColumns(told)
    asked = stored(below.select(*keys, F.inline(F.array(*asked))).filter("count > 0"), "ranks")

    hits = [
        F.when(x.between(lo, hi), F.struct(F.lit(i).alias("_column"), F.lit(j).alias("_share"), x.alias("_at")))
        for i, j, x, lo, hi in cells
    ]
    inside = met.select(*keys, F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    place = [*keys, "_column", "_share"]
    counts = stored(inside.groupBy(*place, "_at").agg(F.count(F.lit(1)).alias("_rows")), "values-in-range")
    found = stored(_picked(counts, asked, keys, shares, limit), "order-statistics")

    missed = asked.select(*place).join(found.select(*place), _same(asked, found, place), "leftanti")
    missed = stored(missed.select(*keys, "_column").distinct(), "missed")
    if missed.isEmpty():
        return found.drop("_below")
    every = [F.struct(F.lit(i).alias("_column"), F.col(f"_c{i}").alias("_at")) for i in places]
    long = rows.select(*keys, F.inline(F.array(*every))).filter("_at IS NOT NULL")
    long = join_sized(long, missed, [*keys, "_column"], null_safe=True)
    full = long.groupBy(*keys, "_column", "_at").agg(F.count(F.lit(1)).alias("_rows"))
    full = stored(full.withColumn("_share", F.explode(F.array(*[F.lit(j) for j in range(len(shares))]))), "all-values")
    again = join_null_safe(asked, missed, [*keys, "_column"]).withColumn("_below", F.lit(0).cast("long"))
    rest = _picked(full, again, keys, shares, limit)
    kept = found.join(missed, _same(found, missed, [*keys, "_column"]), "leftanti")
    return kept.unionByName(rest).drop("_below")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[c])
    return same


def _sketched(rows: DataFrame, keys: list[str], places: list[int], shares: list[float], accuracy: int) -> DataFrame:
    """For each key, ``_n`` values of a column and the range ``_lo`` to ``_hi`` of each share."""
    offs = [off for off, _ in WIDTHS] + [1.0]
    asked = [min(1.0, max(0.0, s + sign * off)) for s in shares for off in offs for sign in (-1, 1)]
    aggs = []
    for i in places:
        x = F.col(f"_c{i}")
        aggs += [F.count(x).alias(f"_n{i}"), F.percentile_approx(x, asked, accuracy).alias(f"_at{i}")]
    told = {}
    for i in places:
        width = F.lit(len(WIDTHS))
        for w, (_, least) in reversed(list(enumerate(WIDTHS))):
            width = F.when(F.col(f"_n{i}") >= least, F.lit(w)).otherwise(width)
        told[f"_n{i}"] = F.col(f"_n{i}")
        for j in range(len(shares)):
            at = 2 * (width + j * len(offs))
            told[f"_lo{i}_{j}"], told[f"_hi{i}_{j}"] = F.get(f"_at{i}", at), F.get(f"_at{i}", at + 1)
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *[c.alias(n) for n, c in told.items()])


def _picked(counts: DataFrame, asked: DataFrame, keys: list[str], shares: list[float], limit: int) -> DataFrame:
    """The percentiles whose ranks both lie among the counted values; ``_below`` rows come before these."""
    place = [*keys, "_column", "_share"]
    ranked = running_total(counts, place, ["_at"], F.col("_rows"), "_first", limit)
    ranked = join_null_safe(ranked, asked, place)
    first = F.col("_first") + F.col("_below")
    low, high, part = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0.0)
    for j, s in enumerate(shares):
        of = F.col("_share") == j
        a, b = _ranks(s)
        exact = F.lit(s) * (F.col("count") - 1)
        low, high = F.when(of, a).otherwise(low), F.when(of, b).otherwise(high)
        part = F.when(of, exact - F.floor(exact)).otherwise(part)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("_rows")), F.col("_at")))

    found = ranked.groupBy(*place, "count", "_below").agg(at(low).alias("_lo"), at(high).alias("_hi"), F.max(part).alias("_part"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")
    )
    return found.filter("_lo IS NOT NULL AND _hi IS NOT NULL").select(*place, "count", "_below", value.alias("_value"))
