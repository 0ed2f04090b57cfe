"""Projections, scalar functions, filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.catalog.registry import query
from aftershock.catalog.scans import CELLS, ROW_REGEX, SPEC, features, half_hour
from aftershock.catalog.sql import (
    history_sql,
    num,
    outlier_sql,
    quartile_sql,
    ratio_sql,
    round2,
    sql,
    sql_all,
    surprise,
    threshold_sql,
    to_slot,
    unit_sql,
)
from aftershock.functions import flags, moments, numbers, prices
from aftershock.operators import gates, history, reshape
from aftershock.operators.encode import ordinal_encode
from aftershock.operators.quartiles import expanding_quartiles
from aftershock.operators.reports import classification_report, rmse_report
from aftershock.plans.sweeps import market_columns, parse_sweep_spec
from aftershock.settings import FLAGS, IMPACTS, SNAPSHOT_ENDS
from aftershock.sources.pages import extract_page_rows

C = F.col


# --- column choice ---------------------------------------------------------


@query("project_columns", sql("SELECT event_id, datetime_gmt, close_released FROM cf", "cf"))
def _project_columns(spark, sf_dir):
    return reshape.project_columns(half_hour(spark, sf_dir), ["event_id", "datetime_gmt", "close_released"])


@query(
    "rename_by_horizon",
    sql("SELECT ts, high AS high_5_10_after, low AS low_5_10_after, close AS close_5_10_after FROM c", "c"),
)
def _rename_by_horizon(spark, sf_dir):
    prices_ = fx.candles(spark, sf_dir).select("ts", "high", "low", "close")
    return reshape.rename_by_horizon(prices_, ["high", "low", "close"], 5, 10)


@query(
    "select_by_prefix",
    sql("SELECT event_id, COLUMNS('^(volatility|pips)_') FROM cf", "cf"),
)
def _select_by_prefix(spark, sf_dir):
    return reshape.select_by_prefix(features(spark, sf_dir), ["volatility", "pips"], ["event_id"])


@query(
    "horizon_columns",
    sql(
        "SELECT event_id, volatility_0_5_after, pips_candle_0_5_after, volatility_5_10_after, pips_candle_5_10_after, "
        "volatility_10_15_after, pips_candle_10_15_after, volatility_15_20_after, pips_candle_15_20_after, "
        "volatility_20_25_after, pips_candle_20_25_after, volatility_25_30_after, pips_candle_25_30_after, "
        "volatility_60_0_before, pips_agg_60_0_before, pips_candle_max_30_60_after FROM cf",
        "cf",
    ),
)
def _horizon_columns(spark, sf_dir):
    names = [*reshape.horizon_columns(SNAPSHOT_ENDS, [], [], "all", True), SPEC.target]
    return features(spark, sf_dir).select("event_id", *names)


@query(
    "column_difference",
    sql(
        "SELECT * EXCLUDE (datetime, datetime_gmt, pips_candle_max_0_30_after, pips_candle_min_0_30_after) "
        "FROM cf",
        "cf",
    ),
)
def _column_difference(spark, sf_dir):
    df = features(spark, sf_dir)
    without = ["datetime", "datetime_gmt", "pips_candle_max_0_30_after", "pips_candle_min_0_30_after"]
    return df.select(*reshape.column_difference(df, without))


# --- numbers out of text -----------------------------------------------------


@query(
    "numeric_token",
    sql_all(
        "SELECT event_id, "
        + ", ".join(f"{num(c)} AS {c}" for c in ("actual", "forecast", "previous"))
        + " FROM r",
        "r",
    ),
)
def _numeric_token(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select(
        "event_id",
        *[numbers.numeric_token(C(c)).alias(c) for c in ("actual", "forecast", "previous")],
    )


@query(
    "signed_surprise",
    sql_all(
        f"SELECT event_id, {surprise('forecast', 'actual', 'forecast_error')} AS surprise, "
        f"coalesce({surprise('previous', 'actual', 'previous_error')}, 9999.0) AS surprise_or_9999 FROM r",
        "r",
    ),
)
def _signed_surprise(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select(
        "event_id",
        numbers.signed_surprise(C("forecast"), C("actual"), C("forecast_error")).alias("surprise"),
        numbers.signed_surprise(C("previous"), C("actual"), C("previous_error"), 9999.0).alias(
            "surprise_or_9999"
        ),
    )


@query(
    "round_decimals",
    f"SELECT o_orderkey, {round2('o_totalprice / 7')} AS price FROM orders",
)
def _round_decimals(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", numbers.round_decimals(C("o_totalprice") / 7).alias("price"))


@query(
    "fill_category",
    sql_all(
        "SELECT event_id, coalesce(forecast_error, 'accurate') AS forecast_error, "
        "coalesce(previous_error, 'accurate') AS previous_error FROM r",
        "r",
    ),
)
def _fill_category(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select(
        "event_id",
        *[flags.fill_category(C(c)).alias(c) for c in ("forecast_error", "previous_error")],
    )


@query("unit_of", sql_all(f"SELECT event_id, {unit_sql('actual')} AS unit FROM r", "r"))
def _unit_of(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select("event_id", numbers.unit_of(C("actual")).alias("unit"))


def _scaled_sql(c: str) -> str:
    return f"{num(c)} * CASE {unit_sql(c)} WHEN 'K' THEN 1000.0 WHEN 'M' THEN 1000000.0 ELSE 1.0 END"


@query("scaled_value", sql_all(f"SELECT event_id, {_scaled_sql('actual')} AS value FROM r", "r"))
def _scaled_value(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select("event_id", numbers.scaled_value(C("actual")).alias("value"))


@query(
    "pct_error",
    sql_all(
        "SELECT event_id, round(CASE WHEN f <> 0 THEN CASE WHEN f >= a THEN 1 ELSE -1 END * "
        "abs(a - f) * 100.0 / abs(f) END, 6) AS error_pct FROM "
        f"(SELECT event_id, {_scaled_sql('forecast')} AS f, {_scaled_sql('actual')} AS a FROM r)",
        "r",
    ),
)
def _pct_error(spark, sf_dir):
    error = numbers.pct_error(numbers.scaled_value(C("forecast")), numbers.scaled_value(C("actual")))
    return fx.every_release(spark, sf_dir).select("event_id", F.round(error, 6).alias("error_pct"))


# --- time ----------------------------------------------------------------------


def _sunday(day: str, nth: int) -> str:
    """The nth Sunday on or after a date."""
    return f"({day} + CAST((7 - dayofweek({day})) % 7 + {7 * (nth - 1)} AS INT))"


_Y = "year(datetime)"
_SPRING = (
    f"CASE WHEN {_Y} >= 2007 THEN {_sunday(f'make_date({_Y}, 3, 1)', 2)} "
    f"ELSE {_sunday(f'make_date({_Y}, 4, 1)', 1)} END + INTERVAL 2 HOUR"
)
_FALL = (
    f"CASE WHEN {_Y} >= 2007 THEN {_sunday(f'make_date({_Y}, 11, 1)', 1)} "
    f"ELSE {_sunday(f'make_date({_Y}, 10, 25)', 1)} END + INTERVAL 1 HOUR"
)
_DST = f"CASE WHEN datetime >= {_SPRING} AND datetime < {_FALL} THEN 1 ELSE 0 END"


@query("dst_flag", sql(f"SELECT o_orderkey, {_DST} AS dst FROM t", "t"))
def _dst_flag(spark, sf_dir):
    return fx.wall_times(spark, sf_dir).select("o_orderkey", moments.dst_flag(C("datetime")).alias("dst"))


@query("apply_dst", sql(f"SELECT o_orderkey, datetime + to_hours({_DST}) AS wall FROM t", "t"))
def _apply_dst(spark, sf_dir):
    return fx.wall_times(spark, sf_dir).select("o_orderkey", moments.apply_dst(C("datetime")).alias("wall"))


@query("to_gmt", sql("SELECT o_orderkey, datetime + INTERVAL 5 HOUR AS gmt FROM t", "t"))
def _to_gmt(spark, sf_dir):
    return fx.wall_times(spark, sf_dir).select("o_orderkey", moments.to_gmt(C("datetime")).alias("gmt"))


@query("round_to_candle", f"SELECT event_id, {to_slot('ts')} AS slot FROM events")
def _round_to_candle(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id", moments.round_to_candle(C("ts")).alias("slot")
    )


@query(
    "shift_minutes",
    "SELECT event_id, ts - INTERVAL 5 MINUTE AS before, ts + INTERVAL 25 MINUTE AS later FROM events",
)
def _shift_minutes(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        moments.shift_minutes(C("ts"), -5).alias("before"),
        moments.shift_minutes(C("ts"), 25).alias("later"),
    )


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, "
    "CAST(month(o_orderdate) AS INT) AS month, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders",
)
def _date_parts(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", *[v.alias(k) for k, v in moments.date_parts(C("o_orderdate")).items()]
    )


@query("day_trunc", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def _day_trunc(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", F.date_trunc("day", "ts").alias("day"))


@query(
    "calendar_time_parse",
    "SELECT event_id, date_trunc('minute', CASE WHEN event_id % 11 = 0 THEN date_trunc('day', ts) "
    "ELSE ts END) AS at FROM events",
)
def _calendar_time_parse(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    texts = e.select(
        "event_id",
        F.year("ts").alias("year"),
        F.date_format("ts", "EEEMMM d").alias("day"),
        F.when(C("event_id") % 11 != 0, F.lower(F.date_format("ts", "h:mma")))
        .when(C("event_id") % 2 == 0, F.lit("All Day"))
        .otherwise(F.lit("Day 2"))
        .alias("time"),
    )
    return texts.select(
        "event_id", moments.calendar_time_parse(C("year"), C("day"), C("time")).alias("at")
    )


@query(
    "year_rollover",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders",
)
def _year_rollover(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    start = F.date_sub(F.to_date("o_orderdate"), F.dayofweek("o_orderdate") - 1)
    weeks = o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "MMM").alias("month"),
        F.year(start).alias("first_year"),
        F.year(F.date_add(start, 6)).alias("last_year"),
    )
    return weeks.select(
        "o_orderkey",
        moments.year_rollover(C("month"), C("first_year"), C("last_year")).alias("year"),
    )


# --- prices and scores ------------------------------------------------------------


@query(
    "price_to_pips",
    "SELECT event_id, CAST(replace(printf('%.4f', 1.0 + value / 1000), '.', '') AS BIGINT) AS pips FROM events",
)
def _price_to_pips(spark, sf_dir):
    price = F.lit(1.0) + C("value") / 1000
    return fx.table(spark, sf_dir, "events").select(
        "event_id", prices.price_to_pips(price).alias("pips")
    )


_FIVE = "OVER (PARTITION BY indicator ORDER BY datetime_gmt, release_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_RB_ROLL = (
    "SELECT *, CASE WHEN count(v) " + _FIVE + " = 5 THEN stddev_samp(CAST(v AS DOUBLE)) " + _FIVE
    + " ELSE CAST(v AS DOUBLE) END AS v_std, CASE WHEN count(v) " + _FIVE
    + " = 5 THEN avg(CAST(v AS DOUBLE)) " + _FIVE + " ELSE CAST(v AS DOUBLE) END AS v_mean FROM rb"
)
_RB_PAST = (
    "SELECT *, coalesce(list_sort(list(CAST(v AS DOUBLE)) OVER (PARTITION BY indicator "
    "ORDER BY datetime_gmt, release_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS past FROM rb"
)


def rolled(spark, sf_dir):
    return history.rolling_std_mean(
        fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER
    )


@query(
    "safe_ratio",
    sql(
        f"SELECT release_id, round({ratio_sql('CAST(v AS DOUBLE)', 'v_std', 'v_mean')}, 6) AS ratio, "
        f"round({ratio_sql('CAST(v AS DOUBLE)', '0.0', 'v_mean')}, 6) AS by_mean, "
        f"round({ratio_sql('CAST(v AS DOUBLE)', '0.0', '0.0')}, 6) AS by_step FROM ({_RB_ROLL})",
        "rb",
    ),
)
def _safe_ratio(spark, sf_dir):
    v, zero = C("v").cast("double"), F.lit(0.0)
    return rolled(spark, sf_dir).select(
        "release_id",
        F.round(numbers.safe_ratio(v, C("v_std"), C("v_mean")), 6).alias("ratio"),
        F.round(numbers.safe_ratio(v, zero, C("v_mean")), 6).alias("by_mean"),
        F.round(numbers.safe_ratio(v, zero, zero), 6).alias("by_step"),
    )


@query(
    "outlier_category",
    sql(
        "SELECT release_id, "
        + outlier_sql("CAST(v AS DOUBLE)", "q1", "q3")
        + " AS category FROM (SELECT *, "
        + f"{quartile_sql('past', 'CAST(v AS DOUBLE)', 1)} AS q1, {quartile_sql('past', 'CAST(v AS DOUBLE)', 3)} AS q3 "
        + f"FROM ({_RB_PAST}))",
        "rb",
    ),
)
def _outlier_category(spark, sf_dir):
    q = expanding_quartiles(fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER)
    return q.select(
        "release_id",
        numbers.outlier_category(C("v").cast("double"), C("v_q1"), C("v_q3")).alias("category"),
    )


_CANDLES_5M = [f"pips_candle_{e - 5}_{e}_after" for e in SNAPSHOT_ENDS]


@query(
    "majority_direction",
    sql(
        "SELECT event_id, CASE WHEN (CASE WHEN len(a) = 6 THEN list_sum(list_transform(a, lambda v: sign(v))) "
        "ELSE a[-1] END) < 0 THEN -1 ELSE 1 END AS direction FROM (SELECT event_id, list_filter(["
        + ", ".join(_CANDLES_5M)
        + "], lambda v: v IS NOT NULL) AS a FROM cf)",
        "cf",
    ),
)
def _majority_direction(spark, sf_dir):
    moves = F.array_compact(F.array(*[C(c) for c in _CANDLES_5M]))
    return features(spark, sf_dir, (0,), (30,)).select(
        "event_id", numbers.majority_direction(moves, len(_CANDLES_5M)).alias("direction")
    )


def horizon_sql(columns: str, source: str = "cf") -> str:
    """Horizons of a feature table as rows."""
    from aftershock.settings import horizons

    return " UNION ALL ".join(
        f"SELECT event_id, {a} AS from_min, {b} AS to_min, "
        + ", ".join(f"{c}_{a}_{b}_after AS {c}" for c in columns.split())
        + f" FROM {source}"
        for a, b in horizons()
    )


@query(
    "threshold_label",
    sql(
        f"SELECT event_id, from_min, to_min, CASE WHEN abs(pips_candle_max) >= {threshold_sql('from_min', 'to_min')} "
        f"THEN 1 WHEN abs(pips_candle_max) < {threshold_sql('from_min', 'to_min')} THEN 0 END AS label "
        f"FROM ({horizon_sql('pips_candle_max')})",
        "cf",
    ),
)
def _threshold_label(spark, sf_dir):
    long = reshape.horizons_long(features(spark, sf_dir, snapshots=()), ["event_id"], ["pips_candle_max"])
    label = flags.threshold_label(C("pips_candle_max"), C("from_min"), C("to_min"))
    return long.select("event_id", "from_min", "to_min", label.alias("label"))


# --- encodings -------------------------------------------------------------------------


@query(
    "ordinal_encode",
    sql_all(
        "SELECT event_id, indicator, (SELECT count(DISTINCT s.indicator) FROM r s WHERE s.indicator < r.indicator) "
        "AS indicator_id FROM r",
        "r",
    ),
)
def _ordinal_encode(spark, sf_dir):
    rows = fx.every_release(spark, sf_dir).select("event_id", "indicator")
    return ordinal_encode(rows, "indicator", "indicator_id")


def _hot_sql(column: str, values: tuple[str, ...], prefix: str = "") -> str:
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}{v}\"" for v in values
    )


@query("one_hot", sql_all(f"SELECT event_id, {_hot_sql('impact', IMPACTS)} FROM r", "r"))
def _one_hot(spark, sf_dir):
    hot = flags.one_hot(C("impact"), IMPACTS)
    return fx.every_release(spark, sf_dir).select("event_id", *[v.alias(k) for k, v in hot.items()])


@query(
    "pivot_dummies_concat",
    sql_all(
        f"SELECT event_id, {_hot_sql('forecast_error', FLAGS, 'fe_')}, {_hot_sql('previous_error', FLAGS, 'pe_')}, "
        f"{_hot_sql('impact', IMPACTS)} FROM rc",
        "rc",
    ),
)
def _pivot_dummies_concat(spark, sf_dir):
    columns = flags.dummies(C("forecast_error"), C("previous_error"), C("impact"))
    return fx.every_clean(spark, sf_dir).withColumns(columns).select("event_id", *columns)


def _score_sql(flag: str) -> str:
    return (
        f"CASE {flag} WHEN 'accurate' THEN 0 WHEN 'better' THEN 1 ELSE -1 END * "
        "CASE impact WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
    )


_TOTAL = f"{_score_sql('forecast_error')} + {_score_sql('previous_error')}"


@query("error_score", sql(f"SELECT event_id, {_TOTAL} AS total_error FROM cf", "cf"))
def _error_score(spark, sf_dir):
    total = numbers.error_score(C("forecast_error"), C("impact")) + numbers.error_score(
        C("previous_error"), C("impact")
    )
    return half_hour(spark, sf_dir).select("event_id", total.alias("total_error"))


@query(
    "predictable_flag",
    sql(
        f"SELECT event_id, CASE WHEN {_TOTAL} > 0 AND pips_candle_max_0_30_after > 15 THEN 1 ELSE 0 END "
        "AS predictable FROM cf",
        "cf",
    ),
)
def _predictable_flag(spark, sf_dir):
    total = numbers.error_score(C("forecast_error"), C("impact")) + numbers.error_score(
        C("previous_error"), C("impact")
    )
    flag = numbers.predictable_flag(total, C("pips_candle_max_0_30_after"))
    return half_hour(spark, sf_dir).select("event_id", flag.alias("predictable"))


@query(
    "chosen_flag",
    sql_all("SELECT event_id, CASE WHEN indicator = 'IND_3' THEN 1 ELSE 0 END AS chosen FROM r", "r"),
)
def _chosen_flag(spark, sf_dir):
    return fx.every_release(spark, sf_dir).select(
        "event_id", flags.chosen_flag(C("indicator"), "IND_3").alias("chosen")
    )


@query(
    "value_alias",
    sql(
        "SELECT l_orderkey, sweep_id, CASE (l_orderkey + sweep_id) % 3 WHEN 0 THEN 'max number of pips increased is above "
        "the TH' WHEN 1 THEN 'max number of pips decreased is above the TH' ELSE 'other' END AS shown FROM x",
        "x",
    ),
)
def _value_alias(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("max", "min", "other")])
    code = F.get(names, ((C("l_orderkey") + C("sweep_id")) % 3).cast("int"))
    return fx.scores(spark, sf_dir).select("l_orderkey", "sweep_id", flags.value_alias(code).alias("shown"))


@query(
    "string_to_float",
    sql(
        "SELECT l_orderkey, sweep_id, CASE WHEN l_orderkey % 2 = 0 THEN round(CAST(yhat_reg AS DOUBLE), 2) END AS report_agg "
        "FROM x",
        "x",
    ),
)
def _string_to_float(spark, sf_dir):
    number = F.round(C("yhat_reg").cast("double"), 2).cast("string")
    report = F.when(C("l_orderkey") % 2 == 0, number).otherwise(F.lit("{'0': {'precision': 0.7}}"))
    return fx.scores(spark, sf_dir).select(
        "l_orderkey", "sweep_id", numbers.string_to_float(report).alias("report_agg")
    )


@query(
    "parse_sweep_spec",
    sql(
        "SELECT l_orderkey, sweep_id, ['ALL', 'High', 'Medium', 'Low'][l_orderkey % 4 + 1] AS impact_filter, "
        "CASE WHEN sweep_id % 3 = 0 THEN 'YES' ELSE 'NO' END AS standalone, CAST(l_orderkey % 5 AS INT) AS high_weight, "
        "2 AS medium_weight, CAST(sweep_id % 2 AS INT) AS low_weight, CAST(30 * (l_orderkey % 3) AS INT) AS from_min, "
        "CAST(30 * (sweep_id + 1) AS INT) AS to_min FROM x",
        "x",
    ),
)
def _parse_sweep_spec(spark, sf_dir):
    rows = fx.scores(spark, sf_dir).selectExpr(
        "l_orderkey",
        "sweep_id",
        "concat_ws('_', element_at(array('ALL', 'High', 'Medium', 'Low'), CAST(l_orderkey % 4 AS INT) + 1), "
        "IF(sweep_id % 3 = 0, 'YES', 'NO'), CAST(l_orderkey % 5 AS STRING), '2', CAST(sweep_id % 2 AS STRING)) AS aggregation",
        "concat_ws('_', CAST(30 * (l_orderkey % 3) AS STRING), CAST(30 * (sweep_id + 1) AS STRING)) AS horizon",
    )
    parts = parse_sweep_spec(C("aggregation"), C("horizon"))
    return rows.withColumns(parts).drop("aggregation", "horizon")


@query(
    "first_word",
    sql_all(
        "SELECT event_id, impact, country FROM r",
        "r",
    ),
)
def _first_word(spark, sf_dir):
    titles = fx.every_release(spark, sf_dir).select(
        "event_id",
        F.concat("impact", F.lit(" Impact Expected")).alias("title"),
        F.concat("country", F.lit(" "), "indicator", F.lit(" (DEC)")).alias("name"),
    )
    return titles.select(
        "event_id",
        flags.first_word(C("title")).alias("impact"),
        flags.first_word(C("name")).alias("country"),
    )


@query(
    "provider_flag_map",
    sql_all(
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'better' WHEN 1 THEN 'worse' WHEN 2 THEN 'accurate' END "
        "AS flag FROM r",
        "r",
    ),
)
def _provider_flag_map(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in "ud-?"]), (C("event_id") % 4 + 1).cast("int"))
    return fx.every_release(spark, sf_dir).select("event_id", flags.provider_flag_map(code).alias("flag"))


# --- filters and gates -------------------------------------------------------------------


@query(
    "macro_filter",
    sql("SELECT event_id, forecast, country FROM r WHERE forecast IS NOT NULL AND country = 'USD'", "r"),
)
def _macro_filter(spark, sf_dir):
    return gates.macro_filter(fx.releases(spark, sf_dir), "USD").select("event_id", "forecast", "country")


@query(
    "null_row_gate",
    sql(
        "SELECT event_id, concat_ws(',', CASE WHEN forecast IS NULL THEN 'forecast' END, CASE WHEN forecast_error "
        "IS NULL THEN 'forecast_error' END, CASE WHEN previous_error IS NULL THEN 'previous_error' END) AS reason FROM r",
        "r",
    ),
)
def _null_row_gate(spark, sf_dir):
    columns = ["event_id", "forecast", "forecast_error", "previous_error"]
    passed, rejected = gates.null_row_gate(fx.releases(spark, sf_dir), columns)
    return passed.select("event_id", F.lit("").alias("reason")).unionByName(
        rejected.select("event_id", "reason")
    )


@query(
    "parse_error_gate",
    sql("SELECT count(*) AS errors, min(event_id) AS first_error FROM rh WHERE previous_error_diff IS NULL", "rh"),
)
def _parse_error_gate(spark, sf_dir):
    _, errors = gates.parse_error_gate(
        history.revision_surprise(fx.clean(spark, sf_dir)), "previous_error_diff"
    )
    return errors.agg(F.count(F.lit(1)).alias("errors"), F.min("event_id").alias("first_error"))


@query(
    "week_coverage_gate",
    "WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, "
    "(dayofyear(o_orderdate) - 1) // 7 AS week FROM orders) SELECT o_orderkey, year FROM o WHERE year IN "
    "(SELECT year FROM o GROUP BY year HAVING count(DISTINCT week) = 53)",
)
def _week_coverage_gate(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.floor((F.dayofyear("o_orderdate") - 1) / 7).alias("week"),
    )
    return gates.week_coverage_gate(rows, 53).select("o_orderkey", "year")


@query(
    "market_gap_audit",
    sql("SELECT event_id, datetime_gmt FROM cf WHERE pips_candle_0_30_after IS NULL", "cf"),
)
def _market_gap_audit(spark, sf_dir):
    gaps = gates.market_gap_audit(half_hour(spark, sf_dir), "pips_candle_0_30_after")
    return gaps.select("event_id", "datetime_gmt")


@query("impact_filter", sql("SELECT event_id, impact FROM r WHERE impact = 'High'", "r"))
def _impact_filter(spark, sf_dir):
    return gates.impact_filter(fx.releases(spark, sf_dir), "High").select("event_id", "impact")


@query(
    "isolated_only",
    sql("SELECT datetime, count(*) AS num_news FROM r GROUP BY datetime HAVING count(*) = 1", "r"),
)
def _isolated_only(spark, sf_dir):
    from aftershock.operators.bundles import bundle_count

    return gates.isolated_only(bundle_count(fx.releases(spark, sf_dir)))


@query(
    "indicator_lookup",
    sql("SELECT event_id, indicator, datetime FROM r WHERE indicator = 'IND_3' AND year(datetime) = 2024", "r"),
)
def _indicator_lookup(spark, sf_dir):
    found = gates.indicator_lookup(fx.releases(spark, sf_dir), "IND_3", year=2024)
    return found.select("event_id", "indicator", "datetime")


@query(
    "score_range_filter",
    sql(
        "SELECT * FROM (SELECT sweep_id, round(count(*) FILTER (WHERE y = 1 AND yhat = 1) / CAST(count(*) FILTER "
        "(WHERE yhat = 1) AS DOUBLE), 6) AS precision_above_TH, round(count(*) FILTER (WHERE y = 1 AND yhat = 1) / "
        "CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE), 6) AS recall_above_TH FROM x GROUP BY sweep_id) "
        "WHERE precision_above_TH BETWEEN 0.334 AND 1.0 AND recall_above_TH BETWEEN 0.103 AND 0.59",
        "x",
    ),
)
def _score_range_filter(spark, sf_dir):
    report = classification_report(fx.scores(spark, sf_dir))
    kept = gates.score_range_filter(report, (0.334, 1.0))
    return kept.select("sweep_id", "precision_above_TH", "recall_above_TH")


@query(
    "view_filters",
    sql(
        "SELECT event_id, impact, month, pips_candle_0_30_after AS pips_candle_0_ FROM cf "
        "WHERE impact IN ('High', 'Medium') AND month BETWEEN 1 AND 11",
        "cf",
    ),
)
def _view_filters(spark, sf_dir):
    long = reshape.wide_to_long(half_hour(spark, sf_dir), ["event_id", "impact", "month"], [30])
    shown = gates.view_filters(long, 30, ["High", "Medium"], (1, 11))
    return shown.select("event_id", "impact", "month", "pips_candle_0_")


@query(
    "extreme_filter",
    sql(
        "SELECT release_id, v_deviation FROM ("
        + history_sql("rb", ["v"], "indicator", "datetime_gmt, release_id")
        + ") WHERE v_deviation > 3",
        "rb",
    ),
)
def _extreme_filter(spark, sf_dir):
    scored = history.deviation_score(
        fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER
    )
    return gates.extreme_filter(scored, "v_deviation", 3.0).select("release_id", "v_deviation")


@query(
    "skip_empty_rows",
    sql(
        "SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(row, 'href=\"([^\"]*)\"', 1) AS href FROM p "
        "WHERE pos % 3 = 0 AND regexp_extract(row, 'href=\"([^\"]*)\"', 1) <> ''",
        "p",
    ),
)
def _skip_empty_rows(spark, sf_dir):
    rows = extract_page_rows(fx.table(spark, sf_dir, "pages"), ROW_REGEX, CELLS)
    blanked = rows.withColumn("href", F.when(C("pos") % 3 == 0, C("href")).otherwise(F.lit("")))
    return gates.skip_empty_rows(blanked, "href").select("page_id", "pos", "href")


