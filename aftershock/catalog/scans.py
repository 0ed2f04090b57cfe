"""Sources and sinks: tables are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.catalog import fixtures as fx
from aftershock.catalog.registry import query
from aftershock.catalog.sql import num, sql
from aftershock.functions.numbers import numeric_token
from aftershock.operators.reports import classification_report, rmse_report
from aftershock.operators.reshape import temporal_split, wide_to_long
from aftershock.operators.impact import join_market
from aftershock.plans.curation import curate, market_table
from aftershock.plans.sweeps import SweepSpec, sweep_dataset
from aftershock.session import new_path
from aftershock.settings import HORIZON_ENDS, HORIZON_STARTS, SNAPSHOT_ENDS, CurationConfig
from aftershock.sources.calendar import (
    scan_calendar,
    sink_calendar_by_year,
    sink_rejects,
    split_rejects,
)
from aftershock.sources.candles import TIME_FORMAT, scan_candles
from aftershock.sources.pages import extract_page_rows, scan_page_rows
from aftershock.sources.tables import (
    scan_features,
    scan_union_results,
    sink_features,
    sink_long_export,
    sink_partial_results,
    sink_predictions,
    sink_split_export,
    sink_sweep_dataset,
)

CUT = "2024-01-20 00:00:00"
SPEC = SweepSpec("ALL_NO_3_2_1", "all", "included", "30_60", "basic", "max")

_CALENDAR = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("week", T.IntegerType()),
        *[
            T.StructField(c, T.StringType())
            for c in (
                "indicator",
                "country",
                "impact",
                "actual",
                "forecast",
                "forecast_error",
                "previous",
                "previous_error",
            )
        ],
    ]
)


def features(spark, sf_dir, starts=HORIZON_STARTS, ends=HORIZON_ENDS, snapshots=SNAPSHOT_ENDS):
    """Clean releases with market columns, without history scores."""
    config = CurationConfig(starts=starts, ends=ends, snapshot_ends=snapshots)
    rows = fx.clean(spark, sf_dir)
    return join_market(rows, market_table(rows, fx.stored_candles(spark, sf_dir), config))


def half_hour(spark, sf_dir):
    """Features with the reaction in the first 30 minutes only."""
    return features(spark, sf_dir, (0,), (30,), ())


def scored_features(spark, sf_dir):
    """Features with history scores."""
    return curate(
        fx.releases(spark, sf_dir), fx.stored_candles(spark, sf_dir), fx.CONFIG, gmt_input=True
    )


@query("scan_calendar", sql("SELECT *, CAST(year(datetime) AS INT) AS file_year FROM r", "r"))
def _scan_calendar(spark, sf_dir):
    rows = fx.releases(spark, sf_dir)
    path = new_path(spark, "calendar")
    sink_calendar_by_year(rows, path)
    return scan_calendar(spark, f"{path}/year=*", _CALENDAR)


@query("sink_calendar_by_year", sql("SELECT event_id, CAST(year(datetime) AS INT) AS year, impact FROM r", "r"))
def _sink_calendar_by_year(spark, sf_dir):
    path = new_path(spark, "calendar-by-year")
    sink_calendar_by_year(fx.releases(spark, sf_dir), path)
    back = spark.read.schema(_CALENDAR.add("year", T.IntegerType())).option("header", True).csv(path)
    return back.select("event_id", "year", "impact")


@query("scan_candles", sql("SELECT pair, ts, open, high, low, close FROM c", "c"))
def _scan_candles(spark, sf_dir):
    path = new_path(spark, "candles")
    prices = fx.candles(spark, sf_dir).select(
        F.date_format("ts", TIME_FORMAT).alias("Gmt time"),
        *[(F.col(c) / 10000.0).alias(c.title()) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("Volume"),
    )
    prices.write.option("header", True).csv(path)
    return scan_candles(spark, path, "ALL")


@query("scan_features", sql("SELECT * FROM cf", "cf"))
def _scan_features(spark, sf_dir):
    path = new_path(spark, "features")
    sink_features(features(spark, sf_dir), path)
    return scan_features(spark, path)


@query(
    "sink_features",
    sql(
        "SELECT event_id, datetime_gmt, indicator, forecast_error_diff, pips_candle_0_30_after, "
        "close_released, year FROM cf",
        "cf",
    ),
)
def _sink_half_hour(spark, sf_dir):
    path, text = new_path(spark, "features"), new_path(spark, "features-csv")
    columns = [
        "event_id",
        "datetime_gmt",
        "indicator",
        "forecast_error_diff",
        "pips_candle_0_30_after",
        "close_released",
        "year",
    ]
    rows = features(spark, sf_dir).select(*columns)
    sink_features(rows, path, text)
    return spark.read.schema(rows.schema).option("header", True).csv(text)


def _partial(spark, sf_dir):
    x = fx.scores(spark, sf_dir)
    return classification_report(x).withColumn("model", F.lit("kn"))


_REPORT = """
SELECT sweep_id, round((h0 + h1) / n, 6) AS f1_microavg,
 round(h1 / s1, 6) AS precision_above_TH, round(h1 / r1, 6) AS recall_above_TH,
 CAST(r0 AS BIGINT) AS support_below_TH, CAST(r1 AS BIGINT) AS support_above_TH
FROM (SELECT sweep_id, CAST(count(*) AS DOUBLE) AS n,
       CAST(count(*) FILTER (WHERE y = 0 AND yhat = 0) AS DOUBLE) AS h0,
       CAST(count(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS h1,
       CAST(count(*) FILTER (WHERE yhat = 1) AS DOUBLE) AS s1,
       CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS r0,
       CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS r1
      FROM x GROUP BY sweep_id)
"""


@query("sink_partial_results", sql(_REPORT, "x"))
def _sink_partial_results(spark, sf_dir):
    path = new_path(spark, "partial")
    report = _partial(spark, sf_dir)
    # two writes into the same table: the second adds its sweeps only
    sink_partial_results(report.filter("sweep_id <= 4"), path)
    sink_partial_results(report.filter("sweep_id > 3"), path)
    return spark.read.parquet(path).select(
        "sweep_id",
        "f1_microavg",
        "precision_above_TH",
        "recall_above_TH",
        "support_below_TH",
        "support_above_TH",
    )


@query(
    "scan_union_results",
    sql(
        "SELECT 'clf' AS model_type, sweep_id, f1_microavg AS best_score FROM (" + _REPORT + ") "
        "UNION ALL SELECT 'reg', sweep_id, round(sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg))), 6) "
        "FROM x GROUP BY sweep_id",
        "x",
    ),
)
def _scan_union_results(spark, sf_dir):
    x = fx.scores(spark, sf_dir)
    clf = classification_report(x).select(
        F.lit("clf").alias("model_type"), "sweep_id", F.col("f1_microavg").alias("best_score")
    )
    reg = rmse_report(x).select(
        F.lit("reg").alias("model_type"), "sweep_id", F.col("rmse").alias("best_score")
    )
    paths = [new_path(spark, "results-clf"), new_path(spark, "results-reg")]
    for frame, path in zip((clf, reg), paths, strict=True):
        sink_long_export(frame, path)
    return scan_union_results(spark, paths, clf.schema)


def dataset_sql(source: str = "cs", extra: tuple[str, ...] = ()) -> str:
    """Training table of ALL_NO_3_2_1 / all / included / 30_60 / max."""
    target_pips = "pips_candle_max_30_60_after"
    sums = ["forecast_error_diff_deviation", "previous_error_diff_deviation"]
    ints = ["forecast_error_diff_outlier_class", "previous_error_diff_outlier_class"]
    w = "CASE impact WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
    flags = [f"{p}_{v}" for p in ("fe", "pe") for v in ("accurate", "better", "worse")]
    flag = {"fe": "forecast_error", "pe": "previous_error"}
    cols = [f"round(sum({c} * {w}), 2) AS {c}" for c in sums]
    cols += [f"CAST(sum({c} * {w}) AS BIGINT) AS {c}" for c in ints]
    cols += [
        f"CAST(sum(CASE WHEN {flag[f[:2]]} = '{f[3:]}' THEN {w} ELSE 0 END) AS BIGINT) AS {f}"
        for f in flags
    ]
    cols += [f"count(*) FILTER (WHERE impact = '{i}') AS \"{i}\"" for i in ("High", "Medium", "Low")]
    cols += [f"arg_min({c}, event_id) AS {c}" for c in ("year", "week", "weekday")]
    cols += extra
    market = [f"{m}_{e - 5}_{e}_after" for e in (5, 10, 15, 20, 25, 30) for m in ("volatility", "pips_candle")]
    market += ["volatility_60_0_before", "pips_agg_60_0_before", target_pips]
    return (
        f"SELECT b.*, k.* EXCLUDE (datetime), CASE WHEN abs({target_pips}) >= 15 THEN 1 "
        f"WHEN abs({target_pips}) < 15 THEN 0 END AS reaction_max_30_60_after FROM "
        f"(SELECT datetime, count(*) AS num_news, {', '.join(cols)} FROM {source} GROUP BY datetime) b "
        f"LEFT JOIN (SELECT DISTINCT datetime, {', '.join(market)} FROM {source}) k USING (datetime)"
    )


@query("sink_sweep_dataset", sql(f"SELECT *, '{SPEC.sweep_id}' AS sweep_id FROM ({dataset_sql()})", "cs"))
def _sink_sweep_dataset(spark, sf_dir):
    path = new_path(spark, "sweep-dataset")
    sink_sweep_dataset(sweep_dataset(scored_features(spark, sf_dir), SPEC), SPEC.sweep_id, path)
    return spark.read.parquet(path)


@query(
    "sink_predictions",
    sql("SELECT event_id, CASE WHEN forecast_error_diff > 0 THEN 1 ELSE 0 END AS predicted FROM cf", "cf"),
)
def _sink_predictions(spark, sf_dir):
    path = new_path(spark, "predictions")
    guess = F.when(F.col("forecast_error_diff") > 0, F.lit(1)).otherwise(F.lit(0))
    sink_predictions(half_hour(spark, sf_dir).select("event_id", guess.alias("predicted")), path)
    return spark.read.parquet(path)


@query(
    "sink_long_export",
    sql(
        "SELECT event_id, w AS \"window\", CASE w "
        + " ".join(f"WHEN {e} THEN pips_candle_0_{e}_after" for e in (30, 60, 120, 180, 240))
        + " END AS pips_candle_0_ FROM cf, (SELECT unnest([30, 60, 120, 180, 240]) AS w)",
        "cf",
    ),
)
def _sink_long_export(spark, sf_dir):
    path = new_path(spark, "long")
    long = wide_to_long(features(spark, sf_dir, (0,), snapshots=()), ["event_id"], metrics=["pips_candle"])
    sink_long_export(long, path)
    return spark.read.schema(long.schema).option("header", True).csv(path)


@query(
    "sink_split_export",
    sql(
        f"SELECT event_id, CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS side FROM cf",
        "cf",
    ),
)
def _sink_split_export(spark, sf_dir):
    path = new_path(spark, "split")
    rows = half_hour(spark, sf_dir).select("event_id", "datetime")
    sink_split_export(*temporal_split(rows, F.lit(CUT).cast("timestamp")), path)
    sides = [
        spark.read.parquet(f"{path}/{side}").select("event_id", F.lit(side).alias("side"))
        for side in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


@query(
    "sink_rejects",
    sql(
        "SELECT event_id, previous, concat_ws(',', CASE WHEN "
        f"{num('actual')} IS NULL THEN 'actual' END, CASE WHEN {num('previous')} IS NULL THEN 'previous' END) "
        f"AS reason FROM r WHERE {num('actual')} IS NULL OR {num('previous')} IS NULL",
        "r",
    ),
)
def _sink_rejects(spark, sf_dir):
    path = new_path(spark, "rejects")
    checks = {c: numeric_token(F.col(c)).isNotNull() for c in ("actual", "previous")}
    _, rejects = split_rejects(fx.releases(spark, sf_dir), checks)
    sink_rejects(rejects, path)
    return spark.read.parquet(path).select("event_id", "previous", "reason")


ROW_REGEX = r"<li>(.*?)</li>"
CELLS = {"href": r'href="([^"]*)"', "text": r">([^<]*)<"}


@query(
    "extract_page_rows",
    sql(
        "SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(row, 'href=\"([^\"]*)\"', 1) AS href, "
        "regexp_extract(row, '>([^<]*)<', 1) AS text FROM p",
        "p",
    ),
)
def _extract_page_rows(spark, sf_dir):
    return extract_page_rows(fx.table(spark, sf_dir, "pages"), ROW_REGEX, CELLS)


@query(
    "scan_page_rows",
    sql(
        "SELECT page_id, CAST(pos AS INT) AS pos, regexp_extract(row, 'href=\"([^\"]*)\"', 1) AS href, "
        "regexp_extract(row, '>([^<]*)<', 1) AS text FROM p",
        "p",
    ),
)
def _scan_page_rows(spark, sf_dir):
    """The same rows by scanning tags; rows over lines or with further rows inside would be found too."""
    return scan_page_rows(fx.table(spark, sf_dir, "pages"), "li", CELLS)
