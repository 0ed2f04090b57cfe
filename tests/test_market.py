"""Candles, frames and the invariants of their results."""

import pytest
from pyspark.sql import functions as F

from aftershock.catalog import scans
from aftershock.operators import market
from aftershock.operators.impact import join_release_candle, market_by_instant

# Start, open, high, low, close.  No candle from 10:40 to 10:55.
CANDLES = """10:00 1.1200 1.1210 1.1195 1.1205
10:05 1.1205 1.1208 1.1190 1.1192
10:10 1.1192 1.1215 1.1191 1.1211
10:15 1.1211 1.1219 1.1207 1.1208
10:20 1.1208 1.1213 1.1202 1.1204
10:25 1.1204 1.1206 1.1199 1.1201
10:30 1.1201 1.1230 1.1200 1.1226
10:35 1.1226 1.1228 1.1221 1.1223
11:00 1.1223 1.1240 1.1217 1.1238
11:05 1.1238 1.1239 1.1229 1.1231
11:10 1.1231 1.1236 1.1230 1.1235
11:15 1.1235 1.1237 1.1224 1.1225
11:20 1.1225 1.1227 HALF 1.1220"""


def read(spark, tmp_path):
    path = tmp_path / "candles.csv"
    rows = [line.split() for line in CANDLES.replace("HALF", "1.12165").splitlines()]
    lines = [f"03.06.2019 {t}:00.000,{','.join(prices)},7" for t, *prices in rows]
    path.write_text("Gmt time,Open,High,Low,Close,Volume\n" + "\n".join(lines) + "\n")
    from aftershock.sources.candles import scan_candles

    return scan_candles(spark, str(path), "EURUSD")


def test_scan_and_resample(spark, tmp_path):
    candles = read(spark, tmp_path)
    assert candles.columns == ["pair", "ts", "open", "high", "low", "close"]

    def at(size, hour):
        rows = market.ohlc_resample(candles, size).select(
            F.date_format("ts", "HH:mm").alias("t"), "high", "low", "close"
        )
        return tuple(rows.filter(F.col("t") == hour).drop("t").first())

    assert at(15, "09:45") == (11210, 11195, 11205)  # a candle on a boundary closes the window before
    assert at(15, "10:00") == (11219, 11190, 11208)
    assert at(15, "10:15") == (11230, 11199, 11226)
    assert at(30, "10:30") == (11240, 11217, 11238)
    half = candles.filter(F.date_format("ts", "HH:mm") == "11:20").first()
    assert half["low"] == 11217  # 1.12165 is above the half pip in binary


def test_frames_reach_over_gaps_and_fall_back(spark, tmp_path):
    rows = {
        r["t"]: r
        for r in market.market_features(read(spark, tmp_path), [(0, 30), (30, 60), (60, 120)])
        .withColumn("t", F.date_format("ts", "HH:mm"))
        .collect()
    }
    # six candles from 10:30 on, the last four behind the gap
    r = rows["10:30"]
    assert r["volatility_0_30_after"] == 11240 - 11200
    assert r["pips_candle_0_30_after"] == 11225 - 11226
    # nothing ahead: the candle's own prices
    last = rows["11:20"]
    assert last["pips_candle_60_120_after"] == 0
    assert last["pips_candle_max_60_120_after"] == 11227 - 11220  # own high - own close
    assert rows["10:00"]["pips_agg_60_0_before"] == 0


def test_candles_without_a_time_are_numbered_too(spark):
    rows = [("A", "2019-06-03 10:00:00"), ("A", None), ("A", "2019-06-04 10:00:00"), (None, "2019-06-03 10:00:00")]
    df = spark.createDataFrame(rows, "pair string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["pair"], str(r["ts"])[:10], r["candle_no"]) for r in market.number_candles(df).collect()}
    assert got == {("A", "None", 0), ("A", "2019-06-03", 1), ("A", "2019-06-04", 2), (None, "2019-06-03", 0)}


def test_invariants(spark, sf):
    f = scans.features(spark, sf).cache()
    for a, b in ((0, 30), (30, 240)):
        s = f"_{a}_{b}_after"
        assert f.filter(F.col("volatility" + s) < 0).isEmpty()
        spread = F.col("pips_candle_max" + s) - F.col("pips_candle_min" + s)
        assert f.filter(spread != F.col("volatility" + s)).isEmpty()
    bundles = f.groupBy("datetime").count()
    assert bundles.agg(F.sum("count")).first()[0] == f.count()
    f.unpersist()


def test_several_pairs_need_a_pair(spark):
    candles = spark.createDataFrame(
        [(p, "2019-06-03 10:00:00", n, n, n, n) for p, n in (("A", 1), ("B", 2))],
        "pair string, ts string, open long, high long, low long, close long",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    release = spark.sql("SELECT 1 AS event_id, timestamp'2019-06-03 10:05:00' AS datetime_gmt")
    with pytest.raises(ValueError, match="several pairs"):
        join_release_candle(release, candles)
    with pytest.raises(ValueError, match="several pairs"):
        market_by_instant(release, candles)
    both = release.withColumn("pair", F.explode(F.array(F.lit("A"), F.lit("B"))))
    got = {(r["pair"], r["close_released"]) for r in join_release_candle(both, candles).collect()}
    assert got == {("A", 1), ("B", 2)}
    got = {(r["pair"], r["close_released"]) for r in market_by_instant(both, candles, (5,)).collect()}
    assert got == {("A", 1), ("B", 2)}
