"""History, market frames, ordered reports and reshaping."""

from __future__ import annotations


from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.catalog.joins import AFTER
from aftershock.catalog.registry import query
from aftershock.catalog.scalars import _RB_PAST, _RB_ROLL, _TOTAL, rolled
from aftershock.catalog.scans import CELLS, CUT, ROW_REGEX, features, half_hour
from aftershock.catalog.sql import after_sql, before_sql, history_sql, quartile_sql, sql
from aftershock.functions.flags import list_position
from aftershock.operators import bundles, history, market, ordered, reports, reshape, stats
from aftershock.operators.quartiles import expanding_quartiles
from aftershock.plans.dashboards import dashboard_long, predictability
from aftershock.settings import HORIZON_ENDS, horizons
from aftershock.sources.pages import extract_page_rows

C = F.col


@query("previous_value", sql("SELECT event_id, previous_value FROM rp", "rp"))
def _previous_value(spark, sf_dir):
    return history.previous_value(fx.clean(spark, sf_dir)).select("event_id", "previous_value")


@query(
    "revision_surprise",
    sql("SELECT event_id, previous_error_diff, round(total_error_diff, 6) AS total_error_diff FROM rh", "rh"),
)
def _revision_surprise(spark, sf_dir):
    return history.revision_surprise(fx.clean(spark, sf_dir)).select(
        "event_id", "previous_error_diff", F.round("total_error_diff", 6).alias("total_error_diff")
    )


@query(
    "rolling_std_mean",
    sql(f"SELECT release_id, round(v_std, 4) AS v_std, round(v_mean, 4) AS v_mean FROM ({_RB_ROLL})", "rb"),
)
def _rolling_std_mean(spark, sf_dir):
    return rolled(spark, sf_dir).select(
        "release_id", F.round("v_std", 4).alias("v_std"), F.round("v_mean", 4).alias("v_mean")
    )


@query(
    "expanding_quartiles",
    sql(
        f"SELECT release_id, {quartile_sql('past', 'CAST(v AS DOUBLE)', 1)} AS v_q1, "
        f"{quartile_sql('past', 'CAST(v AS DOUBLE)', 3)} AS v_q3 FROM ({_RB_PAST})",
        "rb",
    ),
)
def _expanding_quartiles(spark, sf_dir):
    q = expanding_quartiles(fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER)
    return q.select("release_id", "v_q1", "v_q3")


# All customers as one long indicator, beyond what is sorted in a window.
_ONE = (
    "SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v, coalesce(list_sort(list(CAST(c_acctbal AS DOUBLE)) OVER (ORDER BY "
    "c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS past FROM customer"
)


@query(
    "long_quartiles",
    f"SELECT c_custkey, {quartile_sql('past', 'v', 1)} AS v_q1, {quartile_sql('past', 'v', 3)} AS v_q3 FROM ({_ONE})",
)
def _long_quartiles(spark, sf_dir):
    """Quartiles of earlier values of one key with more rows than are sorted in a window."""
    rows = fx.table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("ONE").alias("indicator"), C("c_acctbal").cast("double").alias("v")
    )
    found = expanding_quartiles(rows, ["v"], ["indicator"], ["c_custkey"], short=128, chunk=512)
    return found.select("c_custkey", "v_q1", "v_q3")


_RB_SCORED = history_sql("rb", ["v"], "indicator", "datetime_gmt, release_id")


@query("deviation_score", sql(f"SELECT release_id, v_deviation FROM ({_RB_SCORED})", "rb"))
def _deviation_score(spark, sf_dir):
    scored = history.deviation_score(
        fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER
    )
    return scored.select("release_id", "v_deviation")


@query("outlier_score", sql(f"SELECT release_id, v_outlier_class FROM ({_RB_SCORED})", "rb"))
def _outlier_score(spark, sf_dir):
    scored = history.outlier_score(
        fx.histories(spark, sf_dir), ["v"], fx.HISTORY_KEYS, fx.HISTORY_ORDER
    )
    return scored.select("release_id", "v_outlier_class")


_BY_PAIR = "PARTITION BY pair"


@query(
    "market_before",
    sql(f"SELECT pair, ts, {', '.join(before_sql(partition=_BY_PAIR))} FROM cp", "cp"),
)
def _market_before(spark, sf_dir):
    rows = market.market_before(fx.pair_candles(spark, sf_dir))
    return rows.select("pair", "ts", "volatility_60_0_before", "pips_agg_60_0_before")


@query(
    "market_after",
    sql(f"SELECT pair, ts, {', '.join(after_sql(partition=_BY_PAIR))} FROM cp", "cp"),
)
def _market_after(spark, sf_dir):
    return market.market_after(fx.pair_candles(spark, sf_dir)).select("pair", "ts", *AFTER)


@query(
    "forward_extremes",
    sql(
        "SELECT ts, "
        + ", ".join(
            f"coalesce(max(high) OVER (ORDER BY ts ROWS BETWEEN {a // 5} FOLLOWING AND {b // 5 - 1} FOLLOWING), high) "
            f"AS high_{a}_{b}, coalesce(min(low) OVER (ORDER BY ts ROWS BETWEEN {a // 5} FOLLOWING AND {b // 5 - 1} "
            f"FOLLOWING), low) AS low_{a}_{b}"
            for a, b in horizons()
        )
        + " FROM c",
        "c",
    ),
)
def _forward_extremes(spark, sf_dir):
    numbered = market.number_candles(fx.stored_candles(spark, sf_dir))
    names = [f"{side}_{a}_{b}" for a, b in horizons() for side in ("high", "low")]
    return market.with_extremes(numbered, horizons()).select("ts", *names)


@query(
    "forward_closes",
    sql(
        "SELECT ts, "
        + ", ".join(
            f"coalesce(lead(close, {a // 5}) OVER (ORDER BY ts), close) AS from_{a}_{b}, "
            f"coalesce(lead(close, {b // 5 - 1}) OVER (ORDER BY ts), close) AS to_{a}_{b}"
            for a, b in horizons()
        )
        + " FROM c",
        "c",
    ),
)
def _forward_closes(spark, sf_dir):
    def columns(w):
        out = {}
        for a, b in horizons():
            out[f"from_{a}_{b}"], out[f"to_{a}_{b}"] = market.forward_closes(w, a, b)
        return out

    names = [f"{side}_{a}_{b}" for a, b in horizons() for side in ("from", "to")]
    numbered = market.number_candles(fx.stored_candles(spark, sf_dir))
    return ordered.framed(numbered, ["pair"], "candle_no", columns, 0, 47).select("ts", *names)


@query(
    "forward_fill",
    sql(
        "SELECT page_id, CAST(pos AS INT) AS pos, last_value(nullif(href, '') IGNORE NULLS) OVER (PARTITION BY page_id "
        "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS href FROM (SELECT page_id, pos, "
        "CASE WHEN pos % 3 = 0 THEN regexp_extract(row, 'href=\"([^\"]*)\"', 1) ELSE '' END AS href FROM p)",
        "p",
    ),
)
def _forward_fill(spark, sf_dir):
    rows = extract_page_rows(fx.table(spark, sf_dir, "pages"), ROW_REGEX, CELLS)
    blanked = rows.select(
        "page_id", "pos", F.when(C("pos") % 3 == 0, C("href")).otherwise(F.lit("")).alias("href")
    )
    return stats.forward_fill(blanked, ["page_id"], "pos", ["href"])


@query(
    "last_n_events",
    sql(
        "SELECT event_id, datetime, indicator FROM rc WHERE datetime IN (SELECT DISTINCT datetime FROM rc "
        "WHERE indicator = 'IND_3' ORDER BY datetime DESC LIMIT 15)",
        "rc",
    ),
)
def _last_n_events(spark, sf_dir):
    rows = fx.clean(spark, sf_dir).select("event_id", "datetime", "indicator")
    return stats.last_n_events(rows, "IND_3", 15)


@query(
    "week_numbering",
    "SELECT o_orderkey, year, dense_rank() OVER (PARTITION BY year ORDER BY week_start) AS week_no FROM "
    "(SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) - "
    "CAST(dayofweek(o_orderdate) AS INT) AS week_start FROM orders)",
)
def _week_numbering(spark, sf_dir):
    rows = stats.week_numbering(fx.table(spark, sf_dir, "orders"), "o_orderdate")
    return rows.select("o_orderkey", "year", C("week_no").cast("bigint").alias("week_no"))


# --- order, limits, sets ------------------------------------------------------------------------


@query(
    "order_by_time",
    sql(
        "SELECT event_id, indicator, row_number() OVER (PARTITION BY indicator ORDER BY datetime_gmt, event_id) - 1 "
        "AS position FROM rc",
        "rc",
    ),
)
def _order_by_time(spark, sf_dir):
    rows = ordered.row_numbers(
        fx.clean(spark, sf_dir), ["indicator"], fx.RELEASE_ORDER, "position"
    )
    return rows.select("event_id", "indicator", "position").orderBy("indicator", "position")


@query(
    "top_counts",
    sql(
        "SELECT datetime, count(*) AS num_news FROM rc GROUP BY datetime ORDER BY num_news DESC, datetime LIMIT 20",
        "rc",
    ),
)
def _top_counts(spark, sf_dir):
    return stats.top_counts(bundles.bundle_count(fx.clean(spark, sf_dir)), 20, "num_news", "datetime")


@query(
    "head_tail",
    sql(
        "(SELECT event_id, datetime, 'head' AS \"end\" FROM rc ORDER BY datetime, event_id LIMIT 5) UNION ALL "
        "(SELECT event_id, datetime, 'tail' FROM rc ORDER BY datetime DESC, event_id DESC LIMIT 5)",
        "rc",
    ),
)
def _head_tail(spark, sf_dir):
    rows = fx.clean(spark, sf_dir).select("event_id", "datetime")
    return stats.head_tail(rows, ["datetime", "event_id"], 5)


@query(
    "row_range",
    sql("SELECT release_id, datetime_gmt, v FROM rb ORDER BY datetime_gmt, release_id LIMIT 7 OFFSET 5", "rb"),
)
def _row_range(spark, sf_dir):
    rows = fx.histories(spark, sf_dir).select("release_id", "datetime_gmt", "v")
    return stats.row_range(rows, ["datetime_gmt", "release_id"], 5, 12)


@query(
    "rank_by_sum",
    sql(
        "SELECT indicator, CAST(sum(pips_candle_max_0_30_after) AS BIGINT) AS total FROM cf GROUP BY indicator",
        "cf",
    ),
)
def _rank_by_sum(spark, sf_dir):
    return stats.rank_by_sum(half_hour(spark, sf_dir), "indicator", "pips_candle_max_0_30_after")


@query(
    "fixed_order",
    sql(
        "SELECT l_orderkey, sweep_id, variant, CASE variant WHEN 'High_YES_1_1_1' THEN 1 WHEN 'High_NO_1_1_1' THEN 2 "
        "WHEN 'ALL_NO_1_1_1' THEN 3 WHEN 'ALL_NO_3_2_1' THEN 4 WHEN 'ALL_YES_1_1_1' THEN 5 ELSE 0 END AS place FROM "
        "(SELECT l_orderkey, sweep_id, ['ALL_NO_1_1_1', 'ALL_NO_3_2_1', 'ALL_YES_1_1_1', 'High_NO_1_1_1', 'High_YES_1_1_1', "
        "'Low_NO_1_1_1', 'Low_YES_1_1_1'][sweep_id] AS variant FROM x)",
        "x",
    ),
)
def _fixed_order(spark, sf_dir):
    from aftershock.settings import VARIANT_ORDER

    names = [
        "ALL_NO_1_1_1",
        "ALL_NO_3_2_1",
        "ALL_YES_1_1_1",
        "High_NO_1_1_1",
        "High_YES_1_1_1",
        "Low_NO_1_1_1",
        "Low_YES_1_1_1",
    ]
    variant = F.element_at(F.array(*[F.lit(n) for n in names]), C("sweep_id"))
    shown = fx.scores(spark, sf_dir).select("l_orderkey", "sweep_id", variant.alias("variant"))
    return shown.withColumn("place", list_position(C("variant"), VARIANT_ORDER)).orderBy("place", "l_orderkey", "sweep_id")


@query(
    "union_years",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders",
)
def _union_years(spark, sf_dir):
    from aftershock.session import new_path

    path = new_path(spark, "years")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    rows.write.partitionBy("year").parquet(path)
    return spark.read.parquet(path)


@query(
    "union_results",
    sql(
        "SELECT sweep_id, 'clf' AS model_type, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS f1_microavg, "
        "CAST(NULL AS DOUBLE) AS rmse FROM x GROUP BY sweep_id UNION ALL SELECT sweep_id, 'reg', NULL, "
        "round(sqrt(avg((y_reg - yhat_reg) * (y_reg - yhat_reg))), 6) FROM x GROUP BY sweep_id",
        "x",
    ),
)
def _union_results(spark, sf_dir):
    x = fx.scores(spark, sf_dir)
    clf = reports.classification_report(x).select(
        "sweep_id", F.lit("clf").alias("model_type"), "f1_microavg"
    )
    reg = reports.rmse_report(x).select("sweep_id", F.lit("reg").alias("model_type"), "rmse")
    return reports.union_results([clf, reg])


@query(
    "temporal_split",
    sql(
        f"SELECT CASE WHEN datetime < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS side, event_id FROM cf",
        "cf",
    ),
)
def _temporal_split(spark, sf_dir):
    rows = half_hour(spark, sf_dir).select("event_id", "datetime")
    train, test = reshape.temporal_split(rows, F.lit(CUT).cast("timestamp"))
    sides = [
        d.select(F.lit(side).alias("side"), "event_id") for d, side in ((train, "train"), (test, "test"))
    ]
    return sides[0].unionByName(sides[1])


_LONG = " UNION ALL ".join(
    f"SELECT event_id, {e} AS \"window\", pips_candle_0_{e}_after AS pips_candle_0_, "
    f"pips_candle_max_0_{e}_after AS pips_candle_max_0_, pips_candle_min_0_{e}_after AS pips_candle_min_0_ FROM cf"
    for e in HORIZON_ENDS
)


@query("wide_to_long", sql(_LONG, "cf"))
def _wide_to_long(spark, sf_dir):
    return reshape.wide_to_long(features(spark, sf_dir, (0,), snapshots=()), ["event_id"])


@query(
    "dashboard_long",
    sql(
        "SELECT event_id, datetime, indicator, impact, weekday, forecast_error_diff, l.* EXCLUDE (event_id) FROM cf "
        f"JOIN ({_LONG}) l USING (event_id)",
        "cf",
    ),
)
def _dashboard_long(spark, sf_dir):
    columns = ["event_id", "datetime", "indicator", "impact", "weekday", "forecast_error_diff"]
    return dashboard_long(features(spark, sf_dir, (0,), snapshots=()), columns)


_PIPS = [f"pips_candle_max_0_{e}_after" for e in HORIZON_ENDS]


@query(
    "dashboard_predictability",
    sql(
        f"SELECT *, CASE WHEN total_error > 0 AND {_PIPS[0]} > 15 THEN 1 ELSE 0 END AS predictable FROM (SELECT datetime, "
        f"CAST(sum({_TOTAL}) AS BIGINT) AS total_error, "
        + ", ".join(f"arg_min({c}, event_id) AS {c}" for c in _PIPS)
        + " FROM cf WHERE impact = 'High' GROUP BY datetime)",
        "cf",
    ),
)
def _dashboard_predictability(spark, sf_dir):
    return predictability(features(spark, sf_dir, (0,), snapshots=()), "High")


