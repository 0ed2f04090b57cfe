"""Column choice and the move between wide and long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.settings import BEFORE_MINUTES, HORIZON_ENDS, horizons

# --- fixed values: metrics a sweep may use as features ---
BEFORE_FEATURES = ("volatility", "pips_agg")
BASIC_FEATURES = ("volatility", "pips_candle")
ALL_FEATURES = ("volatility", "pips_candle", "pips_candle_max", "pips_candle_min")
LONG_METRICS = ("pips_candle", "pips_candle_max", "pips_candle_min")


def project_columns(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Keeps or drops columns."""
    return df.select(*keep) if keep else df.drop(*drop)


def rename_by_horizon(
    df: DataFrame, metrics: Sequence[str], start: int, end: int, side: str = "after"
) -> DataFrame:
    """Metric columns with their horizon in the name."""
    return df.withColumnsRenamed({m: f"{m}_{start}_{end}_{side}" for m in metrics})


def select_by_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose first name part is one of the prefixes."""
    chosen = [c for c in df.columns if c.split("_")[0] in prefixes]
    return df.select(*keep, *[c for c in chosen if c not in keep])


def select_strings(df: DataFrame) -> DataFrame:
    """The text columns."""
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def horizon_columns(
    snapshot_ends: Sequence[int],
    starts: Sequence[int],
    ends: Sequence[int],
    mode: str = "basic",
    before: bool = False,
    span: int = BEFORE_MINUTES,
) -> list[str]:
    """Names of the market features of a sweep."""
    if mode not in ("basic", "all"):
        raise ValueError(f"mode must be 'basic' or 'all', not {mode!r}")
    metrics = BASIC_FEATURES if mode == "basic" else ALL_FEATURES
    names = [f"{m}_{e - 5}_{e}_after" for e in snapshot_ends for m in BASIC_FEATURES]
    names += [f"{m}_{a}_{b}_after" for a in starts for b in ends if a != b for m in metrics]
    if before:
        names += [f"{m}_{span}_0_before" for m in BEFORE_FEATURES]
    return names


def column_difference(df: DataFrame, without: Sequence[str]) -> list[str]:
    """Feature names: all columns but the given ones, in stable order."""
    return sorted(set(df.columns) - set(without))


def wide_to_long(
    df: DataFrame,
    keep: Sequence[str],
    ends: Sequence[int] = HORIZON_ENDS,
    metrics: Sequence[str] = LONG_METRICS,
) -> DataFrame:
    """One row per horizon that starts at the release."""
    rows = [
        F.struct(
            F.lit(end).alias("window"),
            *[F.col(f"{m}_0_{end}_after").alias(f"{m}_0_") for m in metrics],
        )
        for end in ends
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def horizons_long(
    df: DataFrame,
    keep: Sequence[str],
    metrics: Sequence[str],
    pairs: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per (from, to) horizon."""
    rows = [
        F.struct(
            F.lit(a).alias("from_min"),
            F.lit(b).alias("to_min"),
            *[F.col(f"{m}_{a}_{b}_after").alias(m) for m in metrics],
        )
        for a, b in (horizons() if pairs is None else pairs)
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def temporal_split(df: DataFrame, cut: Column, ts: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, and rows from the cut on."""
    return df.filter(F.col(ts) < cut), df.filter(F.col(ts) >= cut)


def hash_share(key: Column) -> Column:
    """Reproducible number in [0, 1) from a key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(
        float(2**32)
    )


def random_split(df: DataFrame, key: str, test_share: float) -> DataFrame:
    """Marks a reproducible share of the rows as test rows."""
    return df.withColumn("is_test", (hash_share(F.col(key)) < test_share).cast("int"))


def fold_of(key: Column, folds: int) -> Column:
    """Reproducible fold of a key."""
    return F.floor(hash_share(F.concat(F.lit("fold"), key.cast("string"))) * folds).cast("int")
