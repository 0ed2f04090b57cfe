"""Named sub-queries shared by the reference SQL of the registered queries."""

from __future__ import annotations

from aftershock.settings import SNAPSHOT_ENDS, THRESHOLDS, horizons


def num(c: str) -> str:
    return (
        f"TRY_CAST(regexp_replace(regexp_replace({c}, '^[^0-9-]*', ''), '[^0-9]+$', '') AS DOUBLE)"
    )


def round2(x: str) -> str:
    return f"(round_even(({x}) * 100.0, 0) / 100.0)"


def surprise(forecast: str, actual: str, flag: str) -> str:
    d = f"abs({num(actual)} - {num(forecast)})"
    return round2(f"CASE WHEN {flag} = 'better' OR {d} = 0 THEN {d} ELSE -{d} END")


def to_slot(ts: str) -> str:
    return (
        f"make_timestamp(CAST(round_even(epoch_us({ts}) / 300000000.0, 0) AS BIGINT) * 300000000)"
    )


def unit_sql(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, 'K') THEN 'K' WHEN contains({c}, 'M') THEN 'M' "
        f"WHEN contains({c}, '%') THEN '%' WHEN contains({c}, '<') THEN '<' ELSE 'F' END"
    )


def threshold_sql(start: str, end: str) -> str:
    whens = " ".join(
        f"WHEN {start} = {a} AND {end} = {b} THEN {t}" for (a, b), t in THRESHOLDS.items()
    )
    return f"CASE {whens} END"


def ratio_sql(v: str, std: str, mean: str) -> str:
    return (
        f"CASE WHEN {v} = 0 THEN 0.0 WHEN abs({std}) >= 0.01 THEN {v} / {std} "
        f"WHEN abs({mean}) >= 0.01 THEN {v} / {mean} WHEN {v} < 0 THEN {v} - 1 ELSE {v} + 1 END"
    )


def outlier_sql(v: str, q1: str, q3: str) -> str:
    def out(k: float) -> str:
        return f"{v} > {q3} + ({q3} - {q1}) * {k} OR {v} < {q1} - ({q3} - {q1}) * {k}"

    return (
        f"CASE WHEN {q3} IS NULL OR {v} IS NULL THEN 0 WHEN {out(3.0)} THEN 3 WHEN {out(1.5)} THEN 2 "
        f"WHEN {v} > {q3} OR {v} < {q1} THEN 1 ELSE 0 END"
    )


def quartile_sql(past: str, own: str, q: int) -> str:
    n = f"len({past})"
    lo = f"CAST(floor(({n} - 1) * {q} / 4.0) AS INT) + 1"
    hi = f"CAST(ceil(({n} - 1) * {q} / 4.0) AS INT) + 1"
    return (
        f"CASE WHEN {n} >= 5 THEN CASE WHEN ({n} - 1) * {q} % 4 = 0 THEN {past}[{lo}] "
        f"ELSE ({past}[{lo}] + {past}[{hi}]) / 2 END ELSE {own} END"
    )


def history_sql(source: str, fields: list[str], key: str, order: str) -> str:
    """Deviation and outlier class of several fields."""
    w = f"PARTITION BY {key} ORDER BY {order}"
    inner, outer = [], []
    for f in fields:
        five = f"OVER ({w} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
        full = f"count({f}) {five} = 5"
        inner += [
            f"CASE WHEN {full} THEN stddev_samp(CAST({f} AS DOUBLE)) {five} ELSE {f} END AS {f}_std",
            f"CASE WHEN {full} THEN avg(CAST({f} AS DOUBLE)) {five} ELSE {f} END AS {f}_mean",
            f"coalesce(list_sort(list(CAST({f} AS DOUBLE)) FILTER (WHERE {f} IS NOT NULL) OVER ({w} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS {f}_past",
        ]
        v = f"CAST({f} AS DOUBLE)"
        ratio = ratio_sql(v, f"{f}_std", f"{f}_mean")
        outer += [
            f"CAST(printf('%.2f', {ratio}) AS DOUBLE) + 0.0 AS {f}_deviation",
            outlier_sql(v, f"({quartile_sql(f + '_past', v, 1)})", f"({quartile_sql(f + '_past', v, 3)})")
            + f" AS {f}_outlier_class",
        ]
    drop = ", ".join(f"{f}_{p}" for f in fields for p in ("std", "mean", "past"))
    return (
        f"SELECT * EXCLUDE ({drop}), {', '.join(outer)} FROM "
        f"(SELECT *, {', '.join(inner)} FROM {source})"
    )


def after_sql(order: str = "ts", partition: str = "") -> list[str]:
    """Reaction columns of every horizon, over the whole series."""
    w = f"{partition} ORDER BY {order}"
    out = []
    for a, b in horizons():
        i, j = a // 5, b // 5 - 1
        f = f"OVER ({w} ROWS BETWEEN {i} FOLLOWING AND {j} FOLLOWING)"
        hi = f"coalesce(max(high) {f}, high)"
        lo = f"coalesce(min(low) {f}, low)"
        first = f"coalesce(lead(close, {i}) OVER ({w}), close)"
        last = f"coalesce(lead(close, {j}) OVER ({w}), close)"
        s = f"_{a}_{b}_after"
        out += [
            f"{hi} - {lo} AS volatility{s}",
            f"{last} - {first} AS pips_candle{s}",
            f"{last} - close AS pips_agg{s}",
            f"{hi} - {first} AS pips_candle_max{s}",
            f"{lo} - {first} AS pips_candle_min{s}",
        ]
    return out


def before_sql(order: str = "ts", partition: str = "") -> list[str]:
    w = f"{partition} ORDER BY {order}"
    f = f"OVER ({w} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    return [
        f"max(high) {f} - min(low) {f} AS volatility_60_0_before",
        f"open - coalesce(lag(open, 12) OVER ({w}), open) AS pips_agg_60_0_before",
    ]


def _snapshots() -> tuple[str, str]:
    cols, joins = [], []
    for e in SNAPSHOT_ENDS:
        s, t = f"_{e - 5}_{e}_after", f"s{e}"
        cols += [
            f"{t}.high AS high{s}",
            f"{t}.low AS low{s}",
            f"{t}.close AS close{s}",
            f"abs({t}.high - {t}.low) AS volatility{s}",
            f"{t}.close - rel.close AS pips_agg{s}",
            f"{t}.close - {t}.open AS pips_candle{s}",
        ]
        joins.append(f"LEFT JOIN c {t} ON {t}.ts = r0.datetime_gmt + INTERVAL {e - 5} MINUTE")
    return ", ".join(cols), " ".join(joins)


_SNAP_COLS, _SNAP_JOINS = _snapshots()

# Without it all events are releases.
_SIGNUPS = " WHERE event_type = 'signup'"
_RELEASES = f"""
SELECT event_id,
 date_trunc('hour', ts)
   + CASE WHEN extract(minute FROM ts) >= 30 THEN INTERVAL '30' MINUTE ELSE INTERVAL '0' MINUTE END
   - CASE WHEN event_id % 7 = 0 THEN INTERVAL '1' MINUTE ELSE INTERVAL '0' MINUTE END AS datetime,
 CAST(FLOOR((extract(day FROM ts) - 1) / 7) AS INT) + 1 AS week,
 concat('IND_', CAST(user_id % 8 AS STRING)) AS indicator,
 CASE WHEN event_id % 5 = 0 THEN 'EUR' ELSE 'USD' END AS country,
 CASE user_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS impact,
 concat(CAST(CAST(value AS DECIMAL(10,2)) AS STRING), u) AS actual,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat(CAST(5 * k AS STRING), u) END AS forecast,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 5 * k THEN 'better' ELSE 'worse' END AS forecast_error,
 CASE WHEN event_id % 50 = 0 THEN 'Pass' ELSE concat(CAST(4 * k AS STRING), u) END AS previous,
 CASE event_id % 4 WHEN 0 THEN 'better' WHEN 1 THEN 'worse' ELSE NULL END AS previous_error
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CASE user_id % 4 WHEN 0 THEN '%' WHEN 1 THEN 'K' WHEN 2 THEN 'M' ELSE '' END AS u
      FROM events{_SIGNUPS})
"""


def _candles(pair: str) -> str:
    return f"""
SELECT pair, slot AS ts, arg_min(pips, ts) AS open, max(pips) AS high, min(pips) AS low,
       arg_max(pips, ts) AS close
FROM (SELECT {pair} AS pair, time_bucket(INTERVAL '5' MINUTE, ts) AS slot, ts,
             CAST(round(value * 100) AS BIGINT) AS pips
      FROM events WHERE event_type <> 'signup')
GROUP BY pair, slot
"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "r": ((), _RELEASES),
    "rc": (
        ("r",),
        f"SELECT event_id, datetime, {to_slot('datetime')} AS datetime_gmt, week, indicator, country, "
        "impact, actual, forecast, previous, coalesce(forecast_error, 'accurate') AS forecast_error, "
        "coalesce(previous_error, 'accurate') AS previous_error, "
        "CAST(year(datetime) AS INT) AS year, CAST(quarter(datetime) AS INT) AS quarter, "
        "CAST(month(datetime) AS INT) AS month, CAST(isodow(datetime) - 1 AS INT) AS weekday "
        "FROM r WHERE forecast IS NOT NULL AND country = 'USD'",
    ),
    "rs": (
        ("rc",),
        f"SELECT *, {surprise('forecast', 'actual', 'forecast_error')} AS forecast_error_diff FROM rc",
    ),
    "rp": (
        ("rs",),
        "SELECT *, coalesce(lag(actual) OVER (PARTITION BY indicator ORDER BY datetime_gmt, event_id), "
        "previous) AS previous_value FROM rs",
    ),
    "rh": (
        ("rp",),
        "SELECT *, forecast_error_diff + previous_error_diff AS total_error_diff FROM (SELECT *, "
        f"{surprise('previous_value', 'previous', 'previous_error')} AS previous_error_diff FROM rp)",
    ),
    "rd": (
        ("rh",),
        history_sql(
            "rh",
            ["forecast_error_diff", "previous_error_diff", "total_error_diff"],
            "indicator",
            "datetime_gmt, event_id",
        ),
    ),
    "c": ((), _candles("'ALL'")),
    "cp": ((), _candles("event_type")),
    "m": (
        ("c",),
        f"SELECT *, {', '.join(after_sql() + before_sql())} FROM c",
    ),
    "i": (("rs",), "SELECT DISTINCT datetime_gmt FROM rs"),
    "mi": (
        ("i", "m", "c"),
        "SELECT r0.datetime_gmt, m.* EXCLUDE (pair, ts, open, high, low, close), "
        "rel.open AS open_released, rel.high AS high_released, rel.low AS low_released, "
        f"rel.close AS close_released, {_SNAP_COLS} FROM i r0 "
        "LEFT JOIN m ON m.ts = r0.datetime_gmt "
        f"LEFT JOIN c rel ON rel.ts = r0.datetime_gmt - INTERVAL 5 MINUTE {_SNAP_JOINS}",
    ),
    # features without and with history scores
    "cf": (("rs", "mi"), "SELECT rs.*, mi.* EXCLUDE (datetime_gmt) FROM rs LEFT JOIN mi USING (datetime_gmt)"),
    "cs": (("rd", "mi"), "SELECT rd.*, mi.* EXCLUDE (datetime_gmt) FROM rd LEFT JOIN mi USING (datetime_gmt)"),
    "rb": (
        (),
        "SELECT o_orderkey AS release_id, concat('CUST_', CAST(o_custkey AS STRING)) AS indicator, "
        "o_orderdate AS datetime_gmt, CAST(o_totalprice - 150000 AS DECIMAL(14,2)) AS v FROM orders",
    ),
    "x": (
        (),
        "SELECT l_linenumber AS sweep_id, l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
        "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS yhat, l_quantity AS y_reg, "
        "25.0 + 10 * l_discount AS yhat_reg FROM lineitem",
    ),
    "t": (
        (),
        "SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey % 96) * 15) AS datetime FROM orders",
    ),
    "e": ((), "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings"),
    "p": (
        (),
        "SELECT page_id, pos - 1 AS pos, row FROM (SELECT page_id, "
        "unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS row, "
        "generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) AS pos FROM pages)",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named sub-queries and everything they need in front."""
    done: list[str] = []

    def need(name: str) -> None:
        for dep in CTES[name][0]:
            need(dep)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    if not done:
        return body
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in done)
    return f"WITH {parts} {body}"


def sql_all(body: str, *names: str) -> str:
    """As ``sql``, with all events as releases."""
    return sql(body, *names).replace(_SIGNUPS, "")
