"""Numbers out of decorated text, and surprise scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aftershock.settings import IMPACT_WEIGHT

# --- fixed values: scale of a unit mark ---
UNIT_SCALE = {"K": 1_000.0, "M": 1_000_000.0}


def numeric_token(text: Column) -> Column:
    """Number inside a decorated string; the unit is ignored, no number gives null."""
    head = F.regexp_replace(text, r"^[^0-9-]*", "")
    token = F.regexp_replace(head, r"[^0-9]+$", "")
    return token.try_cast("double")


def unit_of(text: Column) -> Column:
    """Unit mark of a value: K, M, %, <, or F for a plain number."""
    marks = ("K", "M", "%", "<")
    unit = F.when(text.contains(marks[0]), F.lit(marks[0]))
    for mark in marks[1:]:
        unit = unit.when(text.contains(mark), F.lit(mark))
    return unit.otherwise(F.lit("F"))


def scaled_value(text: Column) -> Column:
    """Number of a value multiplied by its unit."""
    unit = unit_of(text)
    scale = F.lit(1.0)
    for mark, factor in UNIT_SCALE.items():
        scale = F.when(unit == mark, F.lit(factor)).otherwise(scale)
    return numeric_token(text) * scale


def round_decimals(value: Column, places: int = 2) -> Column:
    """Round in binary floating point, ties to even, as numpy does."""
    factor = float(10**places)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def signed_surprise(
    forecast: Column, actual: Column, flag: Column, invalid: float | None = None
) -> Column:
    """|actual - forecast|, positive only when the flag says ``better``.

    ``invalid`` replaces the null of an unreadable pair, for users who expect a
    sentinel.
    """
    size = F.abs(numeric_token(actual) - numeric_token(forecast))
    # 0.0 spelled out, so that no negative zero appears
    signed = F.when((flag == "better") | (size == 0.0), size).otherwise(-size)
    rounded = round_decimals(signed)
    return rounded if invalid is None else F.coalesce(rounded, F.lit(float(invalid)))


def pct_error(forecast: Column, actual: Column) -> Column:
    """Error in percent of the forecast, positive when the forecast was not exceeded."""
    size = F.abs(actual - forecast) * 100.0 / F.abs(forecast)
    return F.when(forecast != 0.0, F.when(forecast >= actual, size).otherwise(-size))


def safe_ratio(value: Column, std: Column, mean: Column) -> Column:
    """value / std, falling back to the mean, then to one step away from zero."""
    flat_std = F.abs(std) < 0.01
    flat_mean = F.abs(mean) < 0.01
    return (
        F.when(value == 0.0, F.lit(0.0))
        .when(~flat_std, value / std)
        .when(~flat_mean, value / mean)
        .when(value < 0.0, value - 1.0)
        .otherwise(value + 1.0)
    )


def outlier_category(value: Column, q1: Column, q3: Column) -> Column:
    """0 inside the quartiles, 1 outside, 2 beyond the inner fence, 3 beyond the outer."""
    iqr = q3 - q1
    outside = lambda reach: (value > q3 + iqr * reach) | (value < q1 - iqr * reach)
    return (
        F.when(q3.isNull() | value.isNull(), F.lit(0))
        .when(outside(3.0), F.lit(3))
        .when(outside(1.5), F.lit(2))
        .when((value > q3) | (value < q1), F.lit(1))
        .otherwise(F.lit(0))
    )


def majority_direction(values: Column, size: int) -> Column:
    """Sign of the summed signs; an array of another size speaks by its last element."""
    total = F.aggregate(
        F.transform(values, lambda v: F.signum(v.cast("double"))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    vote = F.when(F.size(values) == size, total).otherwise(
        F.try_element_at(values, F.lit(-1)).cast("double")
    )
    return F.when(vote < 0.0, F.lit(-1)).otherwise(F.lit(1))


def error_score(flag: Column, impact: Column) -> Column:
    """+1 / -1 / 0 for better / worse / accurate, times the weight of the impact."""
    sign = F.when(flag == "accurate", F.lit(0)).when(flag == "better", F.lit(1)).otherwise(F.lit(-1))
    weight = (
        F.when(impact == "Low", F.lit(IMPACT_WEIGHT["Low"]))
        .when(impact == "Medium", F.lit(IMPACT_WEIGHT["Medium"]))
        .otherwise(F.lit(IMPACT_WEIGHT["High"]))
    )
    return sign * weight


def predictable_flag(score: Column, pips: Column, floor: int = 15) -> Column:
    """1 when a good surprise came with a rise of more than ``floor`` pips."""
    return F.when((score > 0) & (pips > floor), F.lit(1)).otherwise(F.lit(0))


def string_to_float(text: Column) -> Column:
    """Number of a text column, null when it is not one."""
    return text.try_cast("double")
