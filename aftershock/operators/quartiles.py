"""Quartiles of all earlier values, exact, for histories of any length.

Short histories are sorted inside a JVM window.  When some key is long, the
rows of every key are numbered in time and cut into chunks of bounded size.
All values before a chunk form a fixed multiset, and because a chunk adds a
bounded number of values, the quartiles of its rows can only lie in a bounded
slice of that multiset.  The slice is found from counts per (time chunk, value
block), fetched by an equi join, and every chunk is then solved on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.operators.ordered import WINDOW_ROWS, largest_group, row_numbers, running_total
from aftershock.operators.sized import join_null_safe
from aftershock.session import stored
from aftershock.settings import HISTORY_ROWS

# Longest history that is sorted anew for every row.
SHORT_ROWS = 1024
# Rows of a chunk of a long history.
CHUNK_ROWS = 262_144


def expanding_quartiles(
    df: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    size: int = HISTORY_ROWS,
    short: int = SHORT_ROWS,
    limit: int = WINDOW_ROWS,
    chunk: int = CHUNK_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """First and third quartile of the strictly earlier values of the same key.

    Between two ranks the mean of both values is taken.  With fewer than
    ``size`` earlier values the row's own value stands in.  Nulls are skipped.
    Adds ``<field>_q1`` and ``<field>_q3``.
    """
    longest = largest_group(df, keys) if longest is None else longest
    if longest <= short:
        w = (
            Window.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        history = {
            f"_{f}_past": F.array_sort(F.collect_list(F.col(f).cast("double")).over(w))
            for f in fields
        }
        out = df.withColumns(history)
        for f in fields:
            past, own = F.col(f"_{f}_past"), F.col(f).cast("double")
            out = out.withColumns(
                {
                    f"{f}_q1": _midpoint(past, own, 1, size),
                    f"{f}_q3": _midpoint(past, own, 3, size),
                }
            )
        return out.drop(*history)
    return _long_quartiles(df, fields, keys, order, size, longest, limit, chunk)


def _midpoint(past: Column, own: Column, quarter: int, size: int) -> Column:
    """Quartile of a sorted array by integer ranks."""
    n = F.size(past)
    low = F.floor((n - 1) * quarter / 4)
    high = F.ceil((n - 1) * quarter / 4)
    at = lambda i: F.get(past, i.cast("int"))
    value = F.when(low == high, at(low)).otherwise((at(low) + at(high)) / 2)
    return F.when(n >= size, value).otherwise(own)


def _long_quartiles(
    df: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    longest: int,
    limit: int,
    chunk: int,
) -> DataFrame:
    id_cols = [*keys, *order]
    # All fields in one go: the field's number is one more key.
    cells = [
        F.struct(F.lit(i).alias("_field"), F.col(f).cast("double").alias("_v"))
        for i, f in enumerate(fields)
    ]
    every = df.select(*id_cols, F.inline(F.array(*cells)))
    keys = [*keys, "_field"]
    # Earlier values of a row.  A row without a value has as many as the next
    # one with a value; behind the last value of a key stands one more place.
    seen = F.col("_v").isNotNull().cast("bigint")
    placed = stored(running_total(every, keys, order, seen, "_n", limit, longest), "placed")
    values = placed.filter("_v is not null").select(*keys, "_n", "_v")
    ends = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.lit(float("inf")).alias("_v"))
    numbered = values.unionByName(ends).withColumn("_chunk", F.floor(F.col("_n") / chunk))
    rows = numbered.select(
        *keys, "_chunk", "_n", "_v",
        F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_base"),
    )
    if longest >= chunk:
        rows = rows.unionByName(_slices(numbered, keys, longest + 1, limit, chunk))
    # Many short keys share a task; a long key is spread chunk by chunk.
    quartiles = [T.StructField(q, T.DoubleType()) for q in ("q1", "q3")]
    solved = (
        rows.repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", "_kind", "_n")
        .mapInPandas(
            _Solver(keys, size), T.StructType([rows.schema[c] for c in [*keys, "_n"]] + quartiles)
        )
    )
    answered = join_null_safe(placed, solved, [*keys, "_n"], "left")
    wide = []
    for i, f in enumerate(fields):
        for q in ("q1", "q3"):
            value = F.when(F.col("_n") >= size, F.col(q)).otherwise(F.col("_v"))
            wide.append(F.max(F.when(F.col("_field") == i, value)).alias(f"{f}_{q}"))
    return join_null_safe(df, answered.groupBy(*id_cols).agg(*wide), id_cols, "left")


def _slices(
    numbered: DataFrame, keys: list[str], longest: int, limit: int, chunk: int
) -> DataFrame:
    """Values before each chunk among which its quartiles must lie."""
    ranked = row_numbers(numbered, keys, ["_v", "_n"], "_m", limit, longest).withColumn(
        "_block", F.floor(F.col("_m") / chunk)
    )
    # Values per (key, value block) in all chunks before a chunk.
    cells = ranked.groupBy(*keys, "_block", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    by_time = Window.partitionBy(*keys, "_block").orderBy("_chunk")
    last = cells.groupBy(*keys).agg(F.max("_chunk").alias("_last"))
    until = F.coalesce(F.lead("_chunk").over(by_time), F.col("_last"))
    seen = (
        join_null_safe(cells, last, keys)
        .withColumn("_seen", F.sum("_rows").over(by_time))
        .withColumn("_until", until)
        .filter(F.col("_until") > F.col("_chunk"))
        .select(
            *keys,
            "_block",
            "_seen",
            F.explode(F.sequence(F.col("_chunk") + 1, F.col("_until"))).alias("_chunk"),
        )
    )
    by_value = Window.partitionBy(*keys, "_chunk").orderBy("_block")
    start = F.sum("_seen").over(by_value) - F.col("_seen")
    before = F.col("_chunk") * chunk
    # Ranks that a quartile of the chunk's rows can have among the values before it.
    asked_for = []
    for quarter in (1, 3):
        low = F.floor((before - 1) * quarter / 4) - chunk
        high = F.ceil((before + chunk - 1) * quarter / 4)
        inside = (F.col("_base") <= high) & (F.col("_base") + F.col("_seen") > low)
        asked_for.append(F.when(inside, F.lit(-quarter)))
    needed = seen.withColumn("_base", start).withColumn(
        "_kind", F.explode(F.array_compact(F.array(*asked_for)))
    )
    # A late value block is asked for by many chunks, so the values are copied
    # to as many salts as there are groups of 16 askers.
    asked = needed.groupBy(*keys, "_block").agg(
        F.ceil(F.count(F.lit(1)) / 16).cast("int").alias("_salts")
    )
    values = join_null_safe(
        ranked.select(*keys, "_block", "_v", F.col("_n").alias("_at")), asked, [*keys, "_block"]
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    askers = join_null_safe(needed, asked, [*keys, "_block"]).withColumn(
        "_salt", F.pmod(F.col("_chunk"), F.col("_salts")).cast("int")
    )
    return (
        join_null_safe(values.drop("_salts"), askers, [*keys, "_block", "_salt"])
        .filter(F.col("_at") < F.col("_chunk") * chunk)
        .select(
            *keys,
            "_chunk",
            F.col("_at").alias("_n"),
            "_v",
            "_kind",
            "_base",
        )
    )


def _equal(values: pd.Series, one) -> np.ndarray:
    """Which values equal one; nulls are equal."""
    return (values.isna() if pd.isna(one) else values == one).to_numpy()


class _Solver:
    """Solves the chunks of one task, one at a time.

    Rows arrive sorted by key and chunk; inside a chunk the slice of earlier
    values come first (kind -1 and -3, one per quartile), then the rows to solve
    in time order (kind 0).
    """

    def __init__(self, keys: list[str], size: int):
        self.keys, self.size = keys, size

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            # Everything but the batch's last chunk is complete.
            last = np.ones(len(batch), dtype=bool)
            for column in [*self.keys, "_chunk"]:
                last &= _equal(batch[column], batch[column].iloc[-1])
            start = len(batch) - int(last[::-1].cumprod().sum())
            if start == 0 and held and self._same(held[-1], batch):
                held.append(batch)
                continue
            if start > 0:
                held.append(batch.iloc[:start])
            if held:
                yield self.solve(pd.concat(held))
            held = [batch.iloc[start:]]
        if held:
            yield self.solve(pd.concat(held))

    def _same(self, a: pd.DataFrame, b: pd.DataFrame) -> bool:
        return all(_equal(b[c].iloc[:1], a[c].iloc[-1])[0] for c in [*self.keys, "_chunk"])

    def solve(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for column in [*self.keys, "_chunk"]:
            a, b = pdf[column], pdf[column].shift()
            change[1:] |= ((a != b) & ~(a.isna() & b.isna())).to_numpy()[1:]
        unit_no = change.cumsum() - 1
        kind = pdf["_kind"].to_numpy()
        own = kind == 0
        out = pdf.loc[own, [*self.keys, "_n"]].copy()
        for quarter in (1, 3):
            used = own | (kind == -quarter)
            out[f"q{quarter}"] = _prefix_quartile(
                unit_no[used],
                own[used],
                pdf["_v"].to_numpy()[used],
                pdf["_n"].to_numpy()[used],
                pdf["_base"].to_numpy()[used],
                quarter,
                self.size,
            )
        return out


def _prefix_quartile(
    unit: np.ndarray,
    own: np.ndarray,
    value: np.ndarray,
    position: np.ndarray,
    base: np.ndarray,
    quarter: int,
    size: int,
) -> np.ndarray:
    """Quartile of everything before each own row; rows are grouped by unit."""
    units = unit.max() + 1
    start = np.full(units, len(unit))
    np.minimum.at(start, unit, np.arange(len(unit)))
    left_out = np.full(units, np.iinfo(np.int64).max)
    np.minimum.at(left_out, unit[~own], base[~own])
    left_out[left_out == np.iinfo(np.int64).max] = 0

    at = np.flatnonzero(own)
    n = position[at]
    answer = value[at].copy()
    enough = n >= size
    at, n = at[enough], n[enough]
    if len(at) == 0:
        return answer
    low = (n - 1) * quarter // 4
    high = -(-(n - 1) * quarter // 4)
    begin, skipped = start[unit[at]], left_out[unit[at]]
    twice = _kth_smallest(
        value,
        np.concatenate([begin, begin]),
        np.concatenate([at, at]),
        np.concatenate([low - skipped, high - skipped]),
    )
    first, second = twice[: len(at)], twice[len(at) :]
    answer[enough] = np.where(low == high, first, (first + second) / 2)
    return answer


def _kth_smallest(
    value: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray
) -> np.ndarray:
    """k-th smallest of value[begin:end] for many ranges at once.

    A wavelet matrix over the ranks: bit by bit from the top, a query follows
    the zeros or the ones depending on how many zeros its range holds.
    """
    sorted_at = np.argsort(value, kind="stable")
    rank = np.empty(len(value), dtype=np.int64)
    rank[sorted_at] = np.arange(len(value))
    begin, end, k = begin.astype(np.int64), end.astype(np.int64), k.astype(np.int64)
    found = np.zeros(len(k), dtype=np.int64)
    for bit in range(max(len(value) - 1, 1).bit_length() - 1, -1, -1):
        ones = (rank >> bit) & 1
        zeros_before = np.concatenate([[0], np.cumsum(1 - ones)])
        zeros = zeros_before[-1]
        zero_begin, zero_end = zeros_before[begin], zeros_before[end]
        go_zero = k < zero_end - zero_begin
        found |= np.where(go_zero, 0, 1 << bit)
        k = np.where(go_zero, k, k - (zero_end - zero_begin))
        begin = np.where(go_zero, zero_begin, zeros + begin - zero_begin)
        end = np.where(go_zero, zero_end, zeros + end - zero_end)
        rank = np.concatenate([rank[ones == 0], rank[ones == 1]])
    return value[sorted_at][found]
