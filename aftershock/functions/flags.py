"""Categories, labels and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aftershock.settings import DIRECTION_TEXT, FLAGS, IMPACTS, THRESHOLDS

# --- fixed values: flags of the second calendar provider ---
PROVIDER_FLAGS = {"u": "better", "d": "worse", "-": "accurate"}


def fill_category(flag: Column, value: str = "accurate") -> Column:
    """Missing flag means the value was as expected."""
    return F.coalesce(flag, F.lit(value))


def lookup(key: Column, table: dict) -> Column:
    """Value of a small constant table, null when the key is unknown."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[key]


def provider_flag_map(code: Column) -> Column:
    """Flag of the second provider in the words of the first."""
    return lookup(code, PROVIDER_FLAGS)


def value_alias(code: Column, table: dict[str, str] = DIRECTION_TEXT) -> Column:
    """Display text of a code; unknown codes show as they are."""
    return F.coalesce(lookup(code, table), code)


def threshold_of(start: Column, end: Column) -> Column:
    """Pips threshold of a horizon, null when the horizon has none."""
    key = F.concat_ws("_", start.cast("string"), end.cast("string"))
    return lookup(key, {f"{a}_{b}": pips for (a, b), pips in THRESHOLDS.items()})


def threshold_label(pips: Column, start: Column, end: Column) -> Column:
    """1 when the reaction reaches the threshold of its horizon, else 0."""
    reached = F.abs(pips) >= threshold_of(start, end)
    return F.when(reached, F.lit(1)).when(~reached, F.lit(0))


def one_hot(column: Column, values: tuple[str, ...], prefix: str = "") -> dict[str, Column]:
    """One 0/1 column per known value, named after the value."""
    return {f"{prefix}{v}": F.when(column == v, F.lit(1)).otherwise(F.lit(0)) for v in values}


def dummies(forecast_flag: Column, previous_flag: Column, impact: Column) -> dict[str, Column]:
    """The 0/1 columns of both flags and of the impact side by side."""
    return {
        **one_hot(forecast_flag, FLAGS, "fe_"),
        **one_hot(previous_flag, FLAGS, "pe_"),
        **one_hot(impact, IMPACTS),
    }


def chosen_flag(column: Column, value: str) -> Column:
    """1 where the column equals a chosen value."""
    return F.when(column == value, F.lit(1)).otherwise(F.lit(0))


def first_word(text: Column) -> Column:
    """Text up to the first blank."""
    return F.split(text, " ")[0]


def list_position(column: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in an explicit order, starting at 1; 0 when not listed."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), column).cast("int")
