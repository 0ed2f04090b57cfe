"""Helpers that the operators of this package share."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.session import new_path

# Text bytes that a Python worker handles at once; work on them takes up to a hundred times as much memory.
SLICE_BYTES = 1 << 20
# Bytes of a table that may be sent to every executor.
BROADCAST_BYTES = 8 << 20
# Size in memory of a number, and of a row's overhead.
_VALUE_BYTES, _ROW_BYTES = 16, 32


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it from there on.

    Later steps read single columns of it, and a lost executor costs nothing
    that was written.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (string, null as empty) and nothing else."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """An object that lives as long as the Python worker, not just for one task."""
    home = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker"))
    found = home.__dict__.get(key)
    if found is None:
        found = home.__dict__[key] = make()
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def ids_type(n: int) -> str:
    """Smallest little-endian unsigned type for ids below ``n``."""
    return "<u2" if n <= 1 << 16 else "<u4"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def measured_bytes(df: DataFrame) -> int:
    """Size of a stored table in memory, from one aggregate; texts and arrays count in full."""
    sizes = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(f"`{f.name}`"))
        elif isinstance(f.dataType, T.ArrayType):
            sizes.append(_VALUE_BYTES * F.greatest(F.size(f"`{f.name}`"), F.lit(0)))
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in sizes]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return row[0] * (_ROW_BYTES + _VALUE_BYTES * len(df.columns)) + sum(row[1:])


def join_measured(
    left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Joins a large side to another one, which is stored and measured first.

    Up to ``limit`` bytes the right side goes to all tasks and the large side
    stays where it is; beyond that both are shuffled.
    """
    right = store(right, "join-side")
    if measured_bytes(right) <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)
