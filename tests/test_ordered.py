"""Long keys give the same results as one plain window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.operators import history, market, ordered, stats
from aftershock.operators.encode import fit_ids
from aftershock.operators.quartiles import _kth_smallest, expanding_quartiles
from aftershock.operators.bundles import bundle_lists, bundle_rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds about half of 4000 rows; values and times repeat; some are null."""
    return spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 2 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 37).cast("string")))
        .alias("indicator"),
        F.timestamp_seconds(1_600_000_000 + (F.xxhash64("id") % 500) * 300).alias("datetime_gmt"),
        F.when(F.col("id") % 41 != 0, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(300)).cast("double") / 10).alias("v"),
        F.col("id").cast("string").alias("actual"),
        F.lit("0").alias("previous"),
    )


def test_row_numbers_by_range(skewed):
    args = (["indicator"], ["datetime_gmt", "event_id"], "n")
    plain = ordered.row_numbers(skewed, *args)
    split = ordered.row_numbers(skewed, *args, limit=100)
    assert rows(plain.select("event_id", "n")) == rows(split.select("event_id", "n"))
    whole = ordered.row_numbers(skewed, [], ["datetime_gmt", "event_id"], "n", limit=100)
    assert sorted(r["n"] for r in whole.collect()) == list(range(4000))


@pytest.mark.parametrize("chunk", [7, 64])
def test_frames_over_long_keys(skewed, chunk):
    order = ["datetime_gmt", "event_id"]
    plain = history.previous_value(skewed, ["indicator"], order)
    split = history.previous_value(skewed, ["indicator"], order, limit=100, chunk=chunk)
    assert rows(plain.select("event_id", "previous_value")) == rows(split.select("event_id", "previous_value"))
    plain = history.deviation_score(skewed, ["v"], ["indicator"], order)
    split = history.deviation_score(skewed, ["v"], ["indicator"], order, limit=100, chunk=chunk)
    assert rows(plain.select("event_id", F.coalesce("v_deviation", F.lit(-1)))) == rows(
        split.select("event_id", F.coalesce("v_deviation", F.lit(-1)))
    )


def brute_quartiles(data):
    """Quartiles of all earlier values of the same key, value by value."""
    past, out = {}, {}
    for key, _, event, v in data:
        if v is None:
            continue
        seen = past.setdefault(key, [])
        if len(seen) < 5:
            out[event] = (v, v)
        else:
            out[event] = tuple(
                float(np.quantile(seen, q, method="midpoint")) if (len(seen) - 1) * q % 1 else sorted(seen)[int((len(seen) - 1) * q)]
                for q in (0.25, 0.75)
            )
        seen.append(v)
    return out


@pytest.mark.parametrize(
    ("short", "chunk", "limit"), [(5000, 0, 10**6), (10, 10**6, 10**6), (10, 128, 10**6), (10, 50, 300)]
)
def test_expanding_quartiles(skewed, short, chunk, limit):
    order = ["datetime_gmt", "event_id"]
    data = sorted(
        ((r["indicator"], r["datetime_gmt"], r["event_id"], r["v"]) for r in skewed.collect()),
        key=lambda r: r[:3],
    )
    want = brute_quartiles(data)
    got = expanding_quartiles(skewed, ["v"], ["indicator"], order, short=short, chunk=chunk or 1, limit=limit)
    found = {r["event_id"]: (r["v_q1"], r["v_q3"]) for r in got.collect() if r["v"] is not None}
    assert len(found) == len(want)
    bad = [(k, want[k], found[k]) for k in want if want[k] != pytest.approx(found[k], abs=1e-12)]
    assert not bad, bad[:5]


def test_kth_smallest_matches_sorting():
    rng = np.random.default_rng(3)
    value = rng.integers(0, 50, 700).astype(float)
    begin = rng.integers(0, 600, 400)
    end = begin + rng.integers(1, 100, 400)
    k = (rng.random(400) * (end - begin)).astype(int)
    got = _kth_smallest(value, begin, end, k)
    want = [np.sort(value[b:e])[i] for b, e, i in zip(begin, end, k, strict=True)]
    assert got.tolist() == want


@pytest.fixture(scope="module")
def candles(spark, sf):
    return fx.pair_candles(spark, sf)


def test_chunks_do_not_change_market_frames(candles):
    names = ["pair", "ts", "volatility_30_240_after", "pips_candle_max_0_60_after", "pips_agg_60_0_before"]
    whole = market.market_features(candles)
    for chunk in (10, 100):
        assert rows(whole.select(*names)) == rows(market.market_features(candles, chunk=chunk).select(*names))


def test_needed_candles_equal_window(candles):
    whole = market.market_features(candles, [(30, 60), (0, 240)])
    found = market.needed_candle_join(candles.select("pair", "ts"), candles, [(30, 60), (0, 240)])
    for a, b in ((30, 60), (0, 240)):
        names = [f"{m}_{a}_{b}_after" for m in market.AFTER_METRICS]
        want = rows(whole.select("pair", "ts", *names, "volatility_60_0_before", "pips_agg_60_0_before"))
        part = found.filter(f"from_min = {a} AND to_min = {b}")
        assert want == rows(
            part.select("pair", "ts", *market.AFTER_METRICS, "volatility_60_0_before", "pips_agg_60_0_before")
        )


@pytest.mark.parametrize(("keep", "included", "chunk"), [(1, True, 65536), (7, False, 10), (97, True, 30), (10**9, True, 100)])
def test_features_at_instants_equal_window(candles, keep, included, chunk):
    """All instants, some of them, and none; instants without a candle give no row."""
    pairs = [(0, 30), (30, 60), (0, 240), (60, 65), (0, 5), (5, 20)]
    whole = market.market_features(candles, pairs, include_release_candle=included).drop("candle_no", *market.PRICES)
    some = F.pmod(F.xxhash64("pair", "ts"), F.lit(keep)) == 0
    asked = candles.select("pair", "ts").filter(some)
    more = asked.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    found = market.market_at(asked.union(asked).union(more), candles, pairs, 60, included, chunk)
    assert rows(found.select(*whole.columns)) == rows(whole.filter(some))


def test_features_at_instants_of_odd_candles(spark):
    """Null pairs and times, several days, single candles, gaps of days between instants."""
    rng = np.random.default_rng(8)
    data = [(None if i % 5 == 0 else f"P{i % 3}", None if i % 97 == 0 else int(t) * 300) for i, t in enumerate(rng.integers(0, 4000, 700))]
    df = spark.createDataFrame(sorted(set(data), key=str), "pair string, t long").dropDuplicates()
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df = df.withColumns({c: F.pmod(F.xxhash64("pair", "ts", F.lit(c)), F.lit(50)) for c in market.PRICES}).cache()
    whole = market.market_features(df, [(0, 30), (30, 120)], 30).drop("candle_no", *market.PRICES)
    some = F.pmod(F.xxhash64("pair", "ts"), F.lit(9)) == 0
    found = market.market_at(df.filter(some), df, [(0, 30), (30, 120)], 30)
    assert sorted(map(str, found.select(*whole.columns).collect())) == sorted(map(str, whole.filter(some).collect()))
    df.unpersist()


def test_only_days_in_reach_are_numbered(spark):
    slots = spark.range(40 * 288).select(F.lit("P").alias("pair"), F.timestamp_seconds(F.col("id") * 300).alias("ts"))
    asked = slots.filter("ts IN (timestamp'1970-01-05 12:00:00', timestamp'1970-01-20 23:00:00')")
    days = market._days_in_reach(slots, asked, 12, 47)
    assert sorted(r["_day"].day for r in days.collect()) == [4, 5, 6, 19, 20, 21]


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_long_pages_are_filled_as_short_ones(spark, limit):
    """Pages of any length, null pages and row numbers, empty cells at the begin and over whole ranges."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(900):
        page = None if i % 4 == 0 else "hot" if i % 4 < 3 else f"p{i % 7}"
        cell = [None, "", f"v{i}"][int(rng.integers(3))] if i > 300 and not 500 < i < 700 else ""
        data.append((page, None if i == 450 else i, cell, f"w{i}" if i % 50 == 49 else ""))
    df = spark.createDataFrame(data, "page string, no int, a string, b string").repartition(6)
    whole = stats.forward_fill(df, ["page"], "no", ["a", "b"])
    parts = stats.forward_fill(df, ["page"], "no", ["a", "b"], limit=limit)
    assert parts.columns == df.columns
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    filled = {(r["page"], r["no"]): r["b"] for r in parts.collect()}
    assert filled["hot", 897] == "w849" and filled[None, 896] is None


def test_time_frames_equal_row_frames_without_gaps(spark):
    slots = spark.range(400).select(
        F.lit("P").alias("pair"),
        F.timestamp_seconds(F.col("id") * 300).alias("ts"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(90)) + 100).alias(c) for i, c in enumerate(market.PRICES)],
    )
    a, b = market.market_features(slots), market.market_features(slots, frame="time")
    assert rows(a.select(*sorted(b.columns))) == rows(b.select(*sorted(b.columns)))


def test_percentiles_and_ids_by_range(skewed):
    shares = {"p": 0.3, "q": 0.75}
    a = stats.exact_percentiles(skewed, ["indicator"], "v", shares)
    b = stats.exact_percentiles(skewed, ["indicator"], "v", shares, limit=20)
    assert rows(a) == rows(b)
    assert rows(fit_ids(skewed, "indicator", "i")) == rows(fit_ids(skewed, "indicator", "i", limit=3))
    values = [r["v"] for r in skewed.filter("indicator = 'hot' and v is not null").collect()]
    hot = a.filter("indicator = 'hot'").first()
    assert hot["q"] == pytest.approx(float(np.quantile(values, 0.75)))


def test_long_bundles_come_in_parts(skewed):
    one = skewed.withColumn("datetime", F.lit("2020-01-01").cast("timestamp"))
    lists = bundle_lists(one, ["event_id"], part_rows=900, limit=500).orderBy("part").collect()
    assert [r["rows"] for r in lists] == [900, 900, 900, 900, 400]
    assert [e for r in lists for e in r["event_id"]] == list(range(4000))


@pytest.fixture(scope="module")
def with_nulls(skewed):
    """A quarter of the keys and, beside the skewed nulls, a run of values is null."""
    gone = F.col("event_id") % 4 == 1
    run = F.col("event_id").between(900, 1100) | (F.col("event_id") > 3980)
    return skewed.withColumns(
        {
            "indicator": F.when(~gone, F.col("indicator")),
            "datetime": F.when(~gone, F.date_trunc("hour", "datetime_gmt")),
            "v": F.when(~run, F.col("v")),
            "forecast_error_diff": F.col("v"),
            "previous_error": F.lit("worse"),
            "impact": F.lit("High"),
        }
    )


ORDER_BY = ["datetime_gmt", "event_id"]
BRANCHES = {
    "row_numbers": lambda df, **o: ordered.row_numbers(df, ["indicator"], ORDER_BY, "n", **o),
    "previous_value": lambda df, **o: history.previous_value(df, ["indicator"], ORDER_BY, **o),
    "revision_surprise": lambda df, **o: history.revision_surprise(df, ["indicator"], ORDER_BY, **o),
    "rolling_std_mean": lambda df, **o: history.rolling_std_mean(df, ["v"], ["indicator"], ORDER_BY, **o),
    "deviation_score": lambda df, **o: history.deviation_score(df, ["v"], ["indicator"], ORDER_BY, **o),
    "outlier_score": lambda df, **o: history.outlier_score(df, ["v"], ["indicator"], ORDER_BY, **o),
    "box_stats": lambda df, **o: stats.box_stats(df, ["indicator"], "v", **o),
    "percentiles": lambda df, **o: stats.exact_percentiles(df, ["indicator"], "v", {"half": 0.5}, **o),
    "bundle_rows": lambda df, **o: bundle_rows(df, **o),
}


def shown(df):
    return sorted((tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.collect()))


@pytest.mark.parametrize("name", BRANCHES)
def test_null_keys_and_values_give_equal_rows_on_both_branches(with_nulls, name):
    plain, split = BRANCHES[name](with_nulls), BRANCHES[name](with_nulls, limit=100)
    assert shown(plain) == shown(split)


@pytest.mark.parametrize("chunk", [5, 100, 1 << 18])
def test_quartiles_with_nulls_are_alike_on_both_branches(with_nulls, chunk):
    df = with_nulls.withColumn("w", F.when(F.col("event_id") % 3 == 0, F.col("v") * 2))
    args = (["v", "w"], ["indicator"], ORDER_BY)
    plain = expanding_quartiles(df, *args, short=1 << 20)
    split = expanding_quartiles(df, *args, short=10, chunk=chunk, limit=100)
    columns = ["event_id", "v_q1", "v_q3", "w_q1", "w_q3"]
    assert shown(plain.select(columns)) == shown(split.select(columns))


def test_cells_and_weeks_without_a_key_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    got = {(r["k"], r["x"], r["cell_avg"]) for r in stats.cell_average(df, ["k"], "x").collect()}
    assert got == {("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, 5.0)}
    times = spark.createDataFrame([("2024-01-03",), (None,)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(str(r["week_no"]) for r in stats.week_numbering(times, "t").collect()) == ["1", "1"]
