"""Joins to a side that is usually small."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.session import stored

# Largest side that is sent to every executor.
BROADCAST_BYTES = 64 * 2**20
# Size in memory of a value that is not text, and of a row's overhead.
_VALUE_BYTES, _ROW_BYTES = 16, 32


def measured_bytes(df: DataFrame) -> int:
    """Size of a stored table in memory, from one aggregate."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sums = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return row[0] * (_ROW_BYTES + _VALUE_BYTES * len(df.columns)) + sum(row[1:])


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join for which null keys are equal; the key columns come from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same: list[Column] = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in on]
    joined = left.join(named, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_right_{k}" for k in on])


def join_sized(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Joins a large side to one row per key.

    The right side is written once and measured.  When it is small enough it is
    broadcast, so that neither a shuffle nor a hot key touches the left side;
    beyond the limit the join shuffles and AQE splits skewed partitions.  With
    ``null_safe`` null keys are equal.
    """
    right = stored(right, "join-side")
    if measured_bytes(right) <= limit:
        right = F.broadcast(right)
    if null_safe:
        return join_null_safe(left, right, [on] if isinstance(on, str) else on, how)
    return left.join(right, on, how)
