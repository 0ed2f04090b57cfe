"""Prices as integer pips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves of 26 bits.
_SPLIT = 134217729.0


def scaled_rint(value: Column, factor: float) -> Column:
    """Nearest integer to the exact product ``value * factor``.

    Text formatting with a fixed number of decimals rounds the exact binary
    value.  A plain ``value * factor`` has already been rounded once, which
    moves products next to a half to the wrong side, so the error of the
    product is computed too and decides those ties.
    """
    high_f = factor * _SPLIT - (factor * _SPLIT - factor)
    low_f = factor - high_f
    product = value * F.lit(factor)
    shifted = value * F.lit(_SPLIT)
    high = shifted - (shifted - value)
    low = value - high
    error = (
        ((high * F.lit(high_f) - product) + high * F.lit(low_f) + low * F.lit(high_f))
        + low * F.lit(low_f)
    )
    floor = F.floor(product).cast("double")
    on_half = (product - floor) == 0.5
    return (
        F.when(on_half & (error > 0.0), floor + 1.0)
        .when(on_half & (error < 0.0), floor)
        .otherwise(F.rint(product))
    )


def price_to_pips(price: Column) -> Column:
    """Price with four decimals as an integer (1.30215 -> 13021)."""
    return scaled_rint(price, 10000.0).cast("bigint")


def two_decimals(value: Column) -> Column:
    """Value rounded as its text with two decimals would be."""
    return scaled_rint(value, 100.0) / F.lit(100.0)
