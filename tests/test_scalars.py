"""Golden values of the row functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from aftershock.functions import flags, moments, numbers, prices
from aftershock.settings import THRESHOLDS

C = F.col


def values(df):
    return [r[0] for r in df.collect()]


def test_numeric_token(spark):
    cases = [
        ("5%", 5.0), ("-0.5%", -0.5), ("<0.50%", 0.5), ("$-350M", -350.0), (".5%", 5.0),
        ("-$350M", None), ("1,234", None), ("Pass", None), ("", None), (None, None), ("12K3", None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = values(df.orderBy("i").select(numbers.numeric_token(C("a"))))
    assert got == [b for _, b in cases]


@pytest.mark.parametrize(
    ("forecast", "actual", "flag", "want"),
    [
        ("1.0%", "1.5%", "better", 0.5),
        ("1.5%", "1.0%", "better", 0.5),
        ("1.0%", "1.5%", "worse", -0.5),
        ("1.0%", "1.5%", "accurate", -0.5),
        ("900K", "1.2M", "worse", -898.8),
        ("2%", "2%", "accurate", 0.0),
        ("Pass", "2%", "better", None),
    ],
)
def test_signed_surprise(spark, forecast, actual, flag, want):
    df = spark.createDataFrame([(forecast, actual, flag)], "f string, a string, g string")
    got = values(df.select(numbers.signed_surprise(C("f"), C("a"), C("g"))))[0]
    assert got == want
    compat = values(df.select(numbers.signed_surprise(C("f"), C("a"), C("g"), 9999.0)))[0]
    assert compat == (9999.0 if want is None else want)


def test_units_and_percent_error(spark):
    df = spark.createDataFrame([("0.8%", "0.4%"), ("5.4", "12.3"), ("2K", "1M")], "f string, a string")
    error = numbers.pct_error(numbers.scaled_value(C("f")), numbers.scaled_value(C("a")))
    got = values(df.select(F.round(error, 6)))
    assert got == [50.0, round(-(12.3 - 5.4) * 100 / 5.4, 6), -49900.0]


def test_safe_ratio(spark):
    rows = [(-0.1, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.1, 0.0, 0.0), (14.8, 0.8648, 0.46), (3.0, 0.001, 1.5), (0.0, 2.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, s double, m double")
    got = values(df.orderBy("i").select(prices.two_decimals(numbers.safe_ratio(C("v"), C("s"), C("m")))))
    assert got == [-1.1, -2.0, 1.1, 17.11, 2.0, 0.0]


def test_outlier_category(spark):
    rows = [(5.0, 0), (9.9, 1), (17.6, 2), (25.1, 3), (-15.1, 3), (None, 0)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v double")
    got = values(df.orderBy("i").select(numbers.outlier_category(C("v"), F.lit(4.0), F.lit(9.0))))
    assert got == [c for _, c in rows]


def test_majority_direction(spark):
    df = spark.createDataFrame(
        [(0, [1, -1, -5]), (1, [-3, 2]), (2, []), (3, [5, -1, 1])], "i int, a array<int>"
    )
    got = values(df.orderBy("i").select(numbers.majority_direction(C("a"), 3)))
    assert got == [-1, 1, 1, 1]


def test_price_to_pips_equals_text_rounding(spark):
    listed = [1.30215, 1.30165, 1.30125, 0.00005, 1.0, 123.45675, 1.23455]
    many = [round(1.0 + i / 100000, 5) for i in range(0, 60000, 7)]
    df = spark.createDataFrame([(p,) for p in listed + many], "p double")
    got = df.select("p", prices.price_to_pips(C("p")).alias("n")).collect()
    assert all(r["n"] == int(format(r["p"], ".4f").replace(".", "")) for r in got)
    two = df.select("p", prices.two_decimals(C("p")).alias("n")).collect()
    assert all(r["n"] == float(format(r["p"], ".2f")) for r in two)


def test_round_decimals_half_even(spark):
    df = spark.createDataFrame([(0, 0.125), (1, 0.375), (2, -2.675)], "i int, v double")
    assert values(df.orderBy("i").select(numbers.round_decimals(C("v")))) == [0.12, 0.38, -2.68]


def test_calendar_to_gmt_candle(spark):
    # wall clock -> GMT candle; the calendar holds standard time
    cases = [
        (datetime(2008, 9, 29, 12, 42), datetime(2008, 9, 29, 13, 42), datetime(2008, 9, 29, 17, 40), 1),
        (datetime(2008, 10, 1, 20, 35), datetime(2008, 10, 1, 21, 35), datetime(2008, 10, 2, 1, 35), 1),
        (datetime(2008, 10, 3, 12, 23), datetime(2008, 10, 3, 13, 23), datetime(2008, 10, 3, 17, 25), 1),
        (datetime(2010, 1, 28, 15, 59), datetime(2010, 1, 28, 15, 59), datetime(2010, 1, 28, 21, 0), 0),
        (datetime(2014, 1, 6, 18, 0), datetime(2014, 1, 6, 18, 0), datetime(2014, 1, 6, 23, 0), 0),
        (datetime(2018, 10, 25, 7, 30), datetime(2018, 10, 25, 8, 30), datetime(2018, 10, 25, 12, 30), 1),
        (datetime(2018, 2, 2, 8, 30), datetime(2018, 2, 2, 8, 30), datetime(2018, 2, 2, 13, 30), 0),
        (datetime(2018, 3, 9, 8, 30), datetime(2018, 3, 9, 8, 30), datetime(2018, 3, 9, 13, 30), 0),
    ]
    df = spark.createDataFrame(
        [(i, str(raw)) for i, (raw, *_) in enumerate(cases)], "i int, s string"
    ).withColumn("raw", F.col("s").cast("timestamp"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    got = df.orderBy("i").select(
        text(moments.apply_dst(C("raw"))),
        text(moments.round_to_candle(moments.to_gmt(C("raw")))),
        moments.dst_flag(C("raw")),
    )
    assert [tuple(r) for r in got.collect()] == [(str(w), str(g), f) for _, w, g, f in cases]


def test_round_to_candle_half_even(spark):
    df = spark.createDataFrame([("2020-01-01 10:02:30",), ("2020-01-01 10:07:30",)], "s string")
    got = values(df.select(F.date_format(moments.round_to_candle(C("s").cast("timestamp")), "HH:mm")))
    assert got == ["10:00", "10:10"]


def test_calendar_time_parse(spark):
    df = spark.createDataFrame(
        [(0, "SunDec 23", "8:30am"), (1, "MonJan 7", "12:05pm"), (2, "TueMar 5", "All Day"), (3, "WedMay 1", "Day 2")],
        "i int, d string, t string",
    )
    parsed = moments.calendar_time_parse(F.lit(2018), C("d"), C("t"))
    got = values(df.orderBy("i").select(F.date_format(parsed, "MM-dd HH:mm")))
    assert got == ["12-23 08:30", "01-07 12:05", "03-05 00:00", "05-01 00:00"]


def test_thresholds(spark):
    rows = [(a, b, t - 1, t, -t) for (a, b), t in THRESHOLDS.items()] + [(0, 90, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, below int, at int, down int")
    label = lambda c: flags.threshold_label(C(c), C("a"), C("b"))
    got = df.select("b", label("below"), label("at"), label("down")).collect()
    for r in got:
        assert tuple(r)[1:] == ((None, None, None) if r["b"] == 90 else (0, 1, 1))
