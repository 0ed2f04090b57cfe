"""Joins of releases and market, and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.catalog.registry import query
from aftershock.catalog.scans import features, half_hour, scored_features
from aftershock.catalog.scalars import horizon_sql
from aftershock.catalog.sql import sql, sql_all
from aftershock.operators import bundles, impact, market, reports, reshape, stats
from aftershock.operators.gates import impact_filter
from aftershock.settings import HORIZON_ENDS, IMPACTS, horizons

C = F.col
# Small enough that bundles of the given tables have several parts.
PART_ROWS = 2
AFTER = [f"{m}_{a}_{b}_after" for a, b in horizons() for m in market.AFTER_METRICS]
MAX_PIPS = [f"pips_candle_max_{a}_{b}_after" for a, b in horizons()]
PROFILE = [
    "forecast_error_diff",
    "year",
    "quarter",
    "month",
    "weekday",
    "week",
    "volatility_0_30_after",
    "pips_candle_0_30_after",
    "pips_agg_0_30_after",
    "pips_candle_max_0_30_after",
    "pips_candle_min_0_30_after",
    "volatility_30_60_after",
    "pips_candle_30_60_after",
    "pips_candle_max_30_240_after",
    "pips_candle_min_30_240_after",
    "volatility_60_0_before",
]


@query(
    "join_release_candle",
    sql(
        "SELECT rs.event_id, c.open AS open_released, c.high AS high_released, c.low AS low_released, "
        "c.close AS close_released FROM rs LEFT JOIN c ON c.ts = rs.datetime_gmt - INTERVAL 5 MINUTE",
        "rs",
        "c",
    ),
)
def _join_release_candle(spark, sf_dir):
    joined = impact.join_release_candle(fx.clean(spark, sf_dir), fx.candles(spark, sf_dir))
    return joined.select("event_id", *[f"{c}_released" for c in market.PRICES])


_OF_PAIR = "concat('pair_', event_id % 3)"


@query(
    "join_release_candle_pairs",
    sql(
        "SELECT x.event_id, x.pair, k.open AS open_released, k.high AS high_released, k.low AS low_released, "
        f"k.close AS close_released FROM (SELECT *, {_OF_PAIR} AS pair FROM rs) x LEFT JOIN (SELECT 'pair_0' AS pair, "
        "* EXCLUDE (pair) FROM c UNION ALL SELECT 'pair_1', c.* EXCLUDE (pair) REPLACE (open + 1 AS open, high + 1 AS high, "
        "low + 1 AS low, close + 1 AS close) FROM c) k ON k.pair = x.pair AND k.ts = x.datetime_gmt - INTERVAL 5 MINUTE",
        "rs",
        "c",
    ),
)
def _join_release_candle_pairs(spark, sf_dir):
    """Two pairs share all instants, a third has no candles."""
    first = fx.stored_candles(spark, sf_dir).withColumn("pair", F.lit("pair_0"))
    second = first.withColumns({"pair": F.lit("pair_1"), **{c: C(c) + 1 for c in market.PRICES}})
    releases = fx.clean(spark, sf_dir).withColumn("pair", F.expr(_OF_PAIR))
    joined = impact.join_release_candle(releases, first.unionByName(second))
    return joined.select("event_id", "pair", *[f"{c}_released" for c in market.PRICES])


@query(
    "join_snapshots_5m",
    sql("SELECT event_id, COLUMNS('_(0_5|5_10|10_15|15_20|20_25|25_30)_after$'), close_released FROM cf", "cf"),
)
def _join_snapshots_5m(spark, sf_dir):
    joined = impact.join_snapshots_5m(fx.clean(spark, sf_dir), fx.stored_candles(spark, sf_dir))
    names = [c for c in joined.columns if c.endswith("_after")]
    return joined.select("event_id", *names, "close_released")


@query(
    "join_before",
    sql("SELECT event_id, volatility_60_0_before, pips_agg_60_0_before FROM cf", "cf"),
)
def _join_before(spark, sf_dir):
    before = market.market_before(fx.stored_candles(spark, sf_dir))
    joined = impact.join_candle_features(fx.clean(spark, sf_dir), before)
    return joined.select("event_id", "volatility_60_0_before", "pips_agg_60_0_before")


@query("join_after", sql(f"SELECT event_id, {', '.join(AFTER)} FROM cf", "cf"))
def _join_after(spark, sf_dir):
    after = market.market_after(fx.stored_candles(spark, sf_dir))
    return impact.join_candle_features(fx.clean(spark, sf_dir), after).select("event_id", *AFTER)


@query(
    "join_bundle_market",
    sql(
        "SELECT datetime, num_news, close_released, pips_candle_max_0_30_after FROM (SELECT datetime, count(*) AS num_news "
        "FROM cf GROUP BY datetime) b LEFT JOIN (SELECT DISTINCT datetime, close_released, pips_candle_max_0_30_after "
        "FROM cf) k USING (datetime)",
        "cf",
    ),
)
def _join_bundle_market(spark, sf_dir):
    rows = half_hour(spark, sf_dir)
    return impact.join_bundle_market(
        bundles.bundle_count(rows), rows, ["close_released", "pips_candle_max_0_30_after"]
    )


@query(
    "join_predictions",
    sql(
        "SELECT event_id, CASE WHEN datetime >= TIMESTAMP '2024-01-20 00:00:00' THEN n % 2 END AS predicted FROM cf "
        "JOIN (SELECT datetime, count(*) AS n FROM cf GROUP BY datetime) USING (datetime)",
        "cf",
    ),
)
def _join_predictions(spark, sf_dir):
    rows = half_hour(spark, sf_dir).select("event_id", "datetime")
    late = rows.filter(C("datetime") >= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    guesses = bundles.bundle_count(late).select("datetime", (C("num_news") % 2).alias("predicted"))
    return impact.join_predictions(rows, guesses).select("event_id", "predicted")


_LONG_SQL = " UNION ALL ".join(
    f"SELECT event_id, {e} AS \"window\", pips_candle_0_{e}_after AS pips_candle_0_, "
    f"pips_candle_max_0_{e}_after AS pips_candle_max_0_, pips_candle_min_0_{e}_after AS pips_candle_min_0_ FROM cf"
    for e in HORIZON_ENDS
)


@query("join_news_windows", sql(_LONG_SQL, "cf"))
def _join_news_windows(spark, sf_dir):
    rows = features(spark, sf_dir, (0,), snapshots=())
    names = [f"{m}_0_{e}_after" for e in HORIZON_ENDS for m in reshape.LONG_METRICS]
    windows = reshape.wide_to_long(rows.select("datetime", *names).dropDuplicates(), ["datetime"])
    return impact.join_news_windows(rows.select("event_id", "datetime"), windows).drop("datetime")


_NEEDED = " UNION ALL ".join(
    f"SELECT ts, {a} AS from_min, {b} AS to_min, volatility_60_0_before, pips_agg_60_0_before, "
    + ", ".join(f"{m}_{a}_{b}_after AS {m}" for m in market.AFTER_METRICS)
    + " FROM m WHERE ts IN (SELECT datetime_gmt FROM rs)"
    for a, b in horizons()
)


@query("needed_candle_join", sql(_NEEDED, "m", "rs"))
def _needed_candle_join(spark, sf_dir):
    instants = fx.clean(spark, sf_dir).select(F.lit("ALL").alias("pair"), C("datetime_gmt").alias("ts"))
    return market.needed_candle_join(instants, fx.stored_candles(spark, sf_dir)).drop("pair")


# --- bundles --------------------------------------------------------------------------------


@query(
    "bundle_lists",
    sql(
        "SELECT datetime, part, CAST(count(*) AS INT) AS rows, string_agg(indicator, ',' ORDER BY event_id) "
        "AS indicators, string_agg(CAST(forecast_error_diff AS STRING), ',' ORDER BY event_id) AS surprises, "
        "arg_min(week, event_id) AS first_week FROM (SELECT *, (row_number() OVER (PARTITION BY datetime "
        f"ORDER BY event_id) - 1) // {PART_ROWS} AS part FROM rs) GROUP BY datetime, part",
        "rs",
    ),
)
def _bundle_lists(spark, sf_dir):
    lists = bundles.bundle_lists(
        fx.clean(spark, sf_dir), ["indicator", "forecast_error_diff"], ["week"], part_rows=PART_ROWS
    )
    return lists.select(
        "datetime",
        "part",
        "rows",
        F.array_join("indicator", ",").alias("indicators"),
        F.array_join(C("forecast_error_diff").cast("array<string>"), ",").alias("surprises"),
        "first_week",
    )


@query(
    "bundle_key",
    sql_all(
        "SELECT datetime, part, string_agg(indicator, '_' ORDER BY event_id) AS new_id FROM (SELECT *, (row_number() "
        f"OVER (PARTITION BY datetime ORDER BY event_id) - 1) // {PART_ROWS} AS part FROM r) GROUP BY datetime, part",
        "r",
    ),
)
def _bundle_key(spark, sf_dir):
    return bundles.bundle_key(fx.every_release(spark, sf_dir), "indicator", part_rows=PART_ROWS)


@query(
    "bundle_rows",
    sql(
        "SELECT datetime, event_id, row_number() OVER (PARTITION BY datetime ORDER BY event_id) - 1 AS position FROM r",
        "r",
    ),
)
def _bundle_rows(spark, sf_dir):
    return bundles.bundle_rows(fx.releases(spark, sf_dir)).select("datetime", "event_id", "position")


@query("bundle_count", sql_all("SELECT datetime, count(*) AS num_news FROM r GROUP BY datetime", "r"))
def _bundle_count(spark, sf_dir):
    return bundles.bundle_count(fx.every_release(spark, sf_dir))


@query(
    "weighted_bundle_sum",
    sql(
        "SELECT datetime, round(sum(forecast_error_diff * CASE impact WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 "
        "ELSE 1 END), 2) AS forecast_error_diff FROM rs GROUP BY datetime",
        "rs",
    ),
)
def _weighted_bundle_sum(spark, sf_dir):
    total = bundles.weighted_bundle_sum("forecast_error_diff", (3, 2, 1))
    return fx.clean(spark, sf_dir).groupBy("datetime").agg(total)


@query(
    "impact_counts",
    sql_all(
        "SELECT datetime, "
        + ", ".join(f"count(*) FILTER (WHERE impact = '{i}') AS \"{i}\"" for i in IMPACTS)
        + " FROM r GROUP BY datetime",
        "r",
    ),
)
def _impact_counts(spark, sf_dir):
    return fx.every_release(spark, sf_dir).groupBy("datetime").agg(*bundles.impact_counts())


@query(
    "bundle_summary",
    sql(
        "SELECT datetime_gmt, round(sum(total_error_diff_deviation), 2) AS total_error_diff_deviation, "
        "count(*) AS num_news, arg_min(pips_agg_25_30_after, event_id) AS pips_agg_25_30_after, "
        "arg_min(pips_agg_0_60_after, event_id) AS pips_agg_0_60_after FROM cs GROUP BY datetime_gmt",
        "cs",
    ),
)
def _bundle_summary(spark, sf_dir):
    return bundles.bundle_summary(
        scored_features(spark, sf_dir),
        "total_error_diff_deviation",
        ["pips_agg_25_30_after", "pips_agg_0_60_after"],
    )


@query(
    "first_per_key",
    sql_all(
        "SELECT indicator, arg_min(forecast, event_id) FILTER (WHERE forecast IS NOT NULL) AS forecast, "
        "arg_min(forecast_error, event_id) FILTER (WHERE forecast_error IS NOT NULL) AS forecast_error "
        "FROM r GROUP BY indicator",
        "r",
    ),
)
def _first_per_key(spark, sf_dir):
    return bundles.first_per_key(
        fx.every_release(spark, sf_dir), ["indicator"], ["forecast", "forecast_error"]
    )


# --- counts and shares -------------------------------------------------------------------------


@query(
    "row_count",
    sql_all(
        "SELECT count(*) AS all_rows, count(*) FILTER (WHERE forecast IS NOT NULL AND country = 'USD') AS macro_rows, "
        "count(*) FILTER (WHERE impact = 'High') AS high_rows FROM r",
        "r",
    ),
)
def _row_count(spark, sf_dir):
    return stats.row_counts(
        fx.every_release(spark, sf_dir),
        {
            "all_rows": F.lit(True),
            "macro_rows": C("forecast").isNotNull() & (C("country") == "USD"),
            "high_rows": C("impact") == "High",
        },
    )


@query(
    "count_by_key",
    sql_all("SELECT impact, indicator, count(*) AS rows FROM rc GROUP BY impact, indicator", "rc"),
)
def _count_by_key(spark, sf_dir):
    return stats.count_by_key(fx.every_clean(spark, sf_dir), ["impact", "indicator"])


@query(
    "distinct_per_impact",
    sql_all("SELECT impact, count(DISTINCT indicator) AS distinct_values FROM rc GROUP BY impact", "rc"),
)
def _distinct_per_impact(spark, sf_dir):
    return stats.distinct_per_impact(fx.every_clean(spark, sf_dir))


@query("distinct_values", sql_all("SELECT DISTINCT indicator FROM r", "r"))
def _distinct_values(spark, sf_dir):
    return stats.distinct_values(fx.every_release(spark, sf_dir), "indicator")


@query(
    "share_by_key",
    sql_all(
        "SELECT forecast_error, rows, round(rows * 100.0 / (SELECT CAST(count(*) AS DOUBLE) FROM rc), 6) AS share "
        "FROM (SELECT forecast_error, count(*) AS rows FROM rc GROUP BY forecast_error)",
        "rc",
    ),
)
def _share_by_key(spark, sf_dir):
    return stats.share_by_key(fx.every_clean(spark, sf_dir), "forecast_error")


@query(
    "bundle_rate",
    sql(
        "SELECT impact, count(*) AS instants, round(100.0 * count(*) FILTER (WHERE n > 1) / CAST(count(*) AS DOUBLE), 6) "
        "AS bundled_pct, round(100.0 * count(*) FILTER (WHERE n = 1) / CAST(count(*) AS DOUBLE), 6) AS isolated_pct FROM "
        "(SELECT 'High' AS impact, datetime, count(*) AS n FROM rc WHERE impact = 'High' GROUP BY datetime UNION ALL "
        "SELECT 'ALL', datetime, count(*) FROM rc GROUP BY datetime) GROUP BY impact",
        "rc",
    ),
)
def _bundle_rate(spark, sf_dir):
    rows = fx.clean(spark, sf_dir)
    sides = {"High": impact_filter(rows, "High"), "ALL": rows}
    rates = [
        stats.bundle_rate(bundles.bundle_count(side)).withColumn("impact", F.lit(name))
        for name, side in sides.items()
    ]
    return rates[0].unionByName(rates[1])


@query(
    "mean_by_key",
    sql("SELECT indicator, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM rb GROUP BY indicator", "rb"),
)
def _mean_by_key(spark, sf_dir):
    rows = fx.histories(spark, sf_dir).withColumn("v", C("v").cast("double"))
    return stats.mean_by_key(rows, ["indicator"], "v")


@query(
    "value_counts",
    sql_all(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS rows FROM rc GROUP BY {c}"
            for c in ("forecast_error", "impact", "previous_error")
        ),
        "rc",
    ),
)
def _value_counts(spark, sf_dir):
    return stats.value_counts(fx.every_clean(spark, sf_dir), ["forecast_error", "impact", "previous_error"])


# --- distributions ------------------------------------------------------------------------------


@query(
    "describe_stats",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
            f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3 FROM cf"
            for c in PROFILE
        ),
        "cf",
    ),
)
def _describe_stats(spark, sf_dir):
    return stats.describe_stats(features(spark, sf_dir, (0, 30), (30, 60, 240), ()), PROFILE)


@query(
    "null_audit",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS non_nulls FROM cf"
            for c in PROFILE
        ),
        "cf",
    ),
)
def _null_audit(spark, sf_dir):
    return stats.null_audit(features(spark, sf_dir, (0, 30), (30, 60, 240), ()), PROFILE)


@query(
    "horizon_thresholds",
    sql(
        "SELECT from_min, to_min, quantile_cont(CAST(pips_candle_max AS DOUBLE), 0.75) AS threshold FROM "
        f"({horizon_sql('pips_candle_max')}) GROUP BY from_min, to_min",
        "cf",
    ),
)
def _horizon_thresholds(spark, sf_dir):
    long = reshape.horizons_long(features(spark, sf_dir, snapshots=()), [], ["pips_candle_max"])
    return stats.horizon_thresholds(long, "pips_candle_max")


@query(
    "histogram",
    sql(
        "SELECT CAST(least(floor((x - lo) * 50.0 / (hi - lo)), 49) AS BIGINT) AS bin, count(*) AS rows FROM "
        "(SELECT CAST(pips_candle_max_0_30_after AS DOUBLE) AS x FROM cf WHERE pips_candle_max_0_30_after IS NOT NULL), "
        "(SELECT CAST(min(pips_candle_max_0_30_after) AS DOUBLE) AS lo, "
        "CAST(max(pips_candle_max_0_30_after) AS DOUBLE) AS hi FROM cf) GROUP BY bin",
        "cf",
    ),
)
def _histogram(spark, sf_dir):
    return stats.histogram(half_hour(spark, sf_dir), "pips_candle_max_0_30_after")


@query(
    "box_stats",
    sql(
        "SELECT impact, q1, median, q3, count(x) AS rows, min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND "
        "q3 + 1.5 * (q3 - q1)) AS whisker_low, max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) "
        "AS whisker_high, count(x) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers "
        "FROM (SELECT impact, CAST(volatility_0_30_after AS DOUBLE) AS x FROM cf) JOIN (SELECT impact, "
        "quantile_cont(CAST(volatility_0_30_after AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(volatility_0_30_after AS DOUBLE), 0.5) AS median, "
        "quantile_cont(CAST(volatility_0_30_after AS DOUBLE), 0.75) AS q3 FROM cf GROUP BY impact) USING (impact) "
        "GROUP BY impact, q1, median, q3",
        "cf",
    ),
)
def _box_stats(spark, sf_dir):
    return stats.box_stats(half_hour(spark, sf_dir), ["impact"], "volatility_0_30_after")


def _corr(a: str, b: str) -> str:
    return f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"


CORR = [c for c in PROFILE if c not in ("year", "quarter", "month")]


@query(
    "correlation_matrix",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS corr FROM cf"
            for i, a in enumerate(CORR)
            for b in CORR[i + 1 :]
        ),
        "cf",
    ),
)
def _correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(features(spark, sf_dir, (0, 30), (30, 60, 240), ()), CORR)


PAIRS = [
    ("forecast_error_diff", "pips_agg_25_30_after"),
    ("forecast_error_diff", "pips_agg_0_60_after"),
    ("pips_agg_25_30_after", "pips_candle_30_60_after"),
]


@query(
    "scatter_pairs",
    sql(
        " UNION ALL ".join(
            f"SELECT event_id, '{a}~{b}' AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, "
            f"(SELECT {_corr(a, b)} FROM cf) AS corr FROM cf WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            for a, b in PAIRS
        ),
        "cf",
    ),
)
def _scatter_pairs(spark, sf_dir):
    return stats.scatter_pairs(features(spark, sf_dir, (0, 30), (60,), (30,)), "event_id", PAIRS)


@query(
    "cell_average",
    sql(
        "SELECT event_id, impact, month, pips_candle_max_0_30_after AS pips, cell_avg FROM cf JOIN (SELECT impact, month, "
        "round(avg(CAST(pips_candle_max_0_30_after AS DOUBLE)), 6) AS cell_avg FROM cf GROUP BY impact, month) "
        "USING (impact, month)",
        "cf",
    ),
)
def _cell_average(spark, sf_dir):
    rows = half_hour(spark, sf_dir).select(
        "event_id", "impact", "month", C("pips_candle_max_0_30_after").alias("pips")
    )
    return stats.cell_average(rows, ["impact", "month"], "pips")


@query(
    "ohlc_resample",
    sql(
        "SELECT pair, time_bucket(INTERVAL '15' MINUTE, ts - INTERVAL 1 MICROSECOND) AS ts, arg_min(open, ts) AS open, "
        "max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM cp "
        "GROUP BY pair, time_bucket(INTERVAL '15' MINUTE, ts - INTERVAL 1 MICROSECOND)",
        "cp",
    ),
)
def _ohlc_resample(spark, sf_dir):
    return market.ohlc_resample(fx.pair_candles(spark, sf_dir), 15)


@query(
    "drop_duplicates",
    sql("SELECT DISTINCT datetime, volatility_0_30_after, pips_candle_max_0_30_after FROM cf", "cf"),
)
def _drop_duplicates(spark, sf_dir):
    rows = half_hour(spark, sf_dir)
    return rows.select(
        "datetime", "volatility_0_30_after", "pips_candle_max_0_30_after"
    ).dropDuplicates()


# --- scores of predictions ---------------------------------------------------------------------


@query(
    "classification_report",
    sql(
        "SELECT sweep_id, round((h0 + h1) / n, 6) AS f1_microavg, round((p0 * r0 + p1 * r1) / n, 6) AS precision_weighted, "
        "round((h0 + h1) / n, 6) AS recall_weighted, round((2 * h0 / (s0 + r0) * r0 + 2 * h1 / (s1 + r1) * r1) / n, 6) "
        "AS f1_weighted, round(p0, 6) AS precision_below_TH, round(h0 / r0, 6) AS recall_below_TH, "
        "round(2 * h0 / (s0 + r0), 6) AS f1_below_TH, round(p1, 6) AS precision_above_TH, round(h1 / r1, 6) "
        "AS recall_above_TH, round(2 * h1 / (s1 + r1), 6) AS f1_above_TH, CAST(r0 AS BIGINT) AS support_below_TH, "
        "CAST(r1 AS BIGINT) AS support_above_TH FROM (SELECT *, h0 / s0 AS p0, h1 / s1 AS p1 FROM (SELECT sweep_id, "
        "CAST(count(*) AS DOUBLE) AS n, "
        + ", ".join(
            f"CAST(count(*) FILTER (WHERE y = {c} AND yhat = {c}) AS DOUBLE) AS h{c}, "
            f"CAST(count(*) FILTER (WHERE yhat = {c}) AS DOUBLE) AS s{c}, "
            f"CAST(count(*) FILTER (WHERE y = {c}) AS DOUBLE) AS r{c}"
            for c in (0, 1)
        )
        + " FROM x GROUP BY sweep_id))",
        "x",
    ),
)
def _classification_report(spark, sf_dir):
    return reports.classification_report(fx.scores(spark, sf_dir))


@query(
    "rmse_report",
    sql(
        "SELECT sweep_id, round(sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg))), 6) AS rmse FROM x GROUP BY sweep_id",
        "x",
    ),
)
def _rmse_report(spark, sf_dir):
    return reports.rmse_report(fx.scores(spark, sf_dir))


@query(
    "best_by_score",
    sql(
        "SELECT sweep_id, score, depth FROM (SELECT sweep_id, depth, score, row_number() OVER (PARTITION BY sweep_id "
        "ORDER BY score DESC, depth) AS i FROM (SELECT sweep_id, CAST(l_orderkey % 6 + 2 AS INT) AS depth, "
        "round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS score FROM x GROUP BY sweep_id, l_orderkey % 6 + 2)) "
        "WHERE i = 1",
        "x",
    ),
)
def _best_by_score(spark, sf_dir):
    x = fx.scores(spark, sf_dir).withColumn("depth", (C("l_orderkey") % 6 + 2).cast("int"))
    grid = x.groupBy("sweep_id", "depth").agg(
        F.round(F.avg((C("y") == C("yhat")).cast("double")), 6).alias("score")
    )
    return reports.best_by_score(grid, ["sweep_id"], "score", ["depth"])


