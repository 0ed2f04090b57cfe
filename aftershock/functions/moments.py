"""Release times: calendar text, daylight saving, GMT and the candle grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aftershock.settings import CANDLE_MINUTES

# Calendar times are New York standard time all year.
_ZONE = "America/New_York"


def minutes(n: int | Column) -> Column:
    """Interval of ``n`` minutes."""
    return F.make_dt_interval(mins=F.lit(n) if isinstance(n, int) else n)


def to_gmt(raw: Column) -> Column:
    """Calendar time to GMT."""
    return raw + minutes(300)


def apply_dst(raw: Column) -> Column:
    """Wall clock in New York at a calendar time."""
    return F.from_utc_timestamp(to_gmt(raw), _ZONE)


def dst_flag(raw: Column) -> Column:
    """1 while daylight saving is on, else 0."""
    return ((F.unix_seconds(apply_dst(raw)) - F.unix_seconds(raw)) / 3600).cast("int")


def round_to_candle(ts: Column, size: int = CANDLE_MINUTES) -> Column:
    """Nearest candle start; exactly half way goes to the even multiple."""
    step = size * 60
    slots = F.rint(F.unix_micros(ts) / F.lit(step * 1_000_000.0))
    return F.timestamp_seconds((slots * F.lit(float(step))).cast("bigint"))


def floor_to_candle(ts: Column, size: int = CANDLE_MINUTES) -> Column:
    """Start of the candle a tick falls into."""
    step = size * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * F.lit(step))


def shift_minutes(ts: Column, offset: int) -> Column:
    """Time moved by a number of minutes."""
    return ts + minutes(offset)


def date_parts(ts: Column) -> dict[str, Column]:
    """year, quarter, month and weekday (Monday is 0)."""
    return {
        "year": F.year(ts),
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "weekday": F.weekday(ts),
    }


def calendar_time_parse(year: Column, day_text: Column, time_text: Column) -> Column:
    """Timestamp from a year, a text such as ``SunDec 23`` and a text such as ``8:30am``.

    Entries without a clock time (``All Day``, ``Day 2``) count as midnight.
    """
    has_clock = time_text.contains("am") | time_text.contains("pm")
    clock = F.when(has_clock, F.upper(time_text)).otherwise(F.lit("12:00AM"))
    text = F.concat_ws(" ", year.cast("string"), F.substring(day_text, 4, 10), clock)
    return F.try_to_timestamp(text, F.lit("yyyy MMM d h:mma"))


def year_rollover(month_text: Column, first_year: Column, last_year: Column) -> Column:
    """Year of a row in a week that may span two years: January belongs to the last."""
    return F.when(month_text == "Jan", last_year).otherwise(first_year)
