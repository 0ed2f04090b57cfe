"""Files, gates and rejects."""

import pytest
from pyspark.sql import functions as F

from aftershock.__main__ import main
from aftershock.catalog import fixtures as fx
from aftershock.catalog.scans import scored_features
from aftershock.operators import gates
from aftershock.plans.curation import clean_releases, curate
from aftershock.settings import CurationConfig
from aftershock.sources.calendar import scan_calendar, scan_provider
from aftershock.sources.candles import scan_candles
from aftershock.sources.pages import scan_page_rows
from aftershock.sources.tables import feature_table_name

HEADER = ",actual,country,datetime,forecast,forecast_error,impact,new,previous,previous_error,week\n"


def write_year(folder, year, rows):
    lines = [",".join([str(i), *r]) for i, r in enumerate(rows)]
    (folder / f"calendar_{year}.csv").write_text(HEADER + "\n".join(lines) + "\n")


def test_scan_and_clean_two_years(spark, tmp_path):
    write_year(
        tmp_path,
        2012,
        [
            ("No", "USD", "2012-07-09 08:15:00", "Yes", "", "High", "Ballot", "", "", "28"),
            ("3.4%", "USD", "2012-07-10 21:20:00", "3.1%", "better", "High", "Output", "2.9%", "", "28"),
            ("3.4%", "CAD", "2012-07-10 21:20:00", "3.1%", "better", "High", "Output", "2.9%", "", "28"),
            ("3.4%", "USD", "2012-07-10 21:20:00", "", "", "Low", "Hearing", "", "", "28"),
        ],
    )
    write_year(
        tmp_path,
        2014,
        [("415K", "USD", "2014-02-20 17:04:00", "400K", "worse", "Low", "Orders", "380K", "worse", "8")],
    )
    calendar = scan_calendar(spark, str(tmp_path / "calendar_*.csv"))
    assert {r["file_year"] for r in calendar.collect()} == {2012, 2014}
    rows = clean_releases(calendar, CurationConfig()).orderBy("datetime_gmt")
    got = rows.select(
        "indicator",
        F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("wall"),
        F.date_format("datetime_gmt", "yyyy-MM-dd HH:mm").alias("gmt"),
        "forecast_error_diff",
        "previous_error",
        "weekday",
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Output", "2012-07-10 22:20", "2012-07-11 02:20", 0.3, "accurate", 1),
        ("Orders", "2014-02-20 17:04", "2014-02-20 22:05", -15.0, "worse", 3),
    ]


def test_curate_from_files(spark, tmp_path):
    rows = [
        (f"{i}.5%", "USD", f"2007-01-08 1{i}:00:00", f"{i}.0%", "better", "High", "Rate", f"{i}.1%", "", "2")
        for i in range(4, 9)
    ]
    write_year(tmp_path, 2007, rows)
    lines = [
        f"08.01.2007 {h:02d}:{m:02d}:00.000,1.30,1.31,1.29,1.3{h % 10}{m % 10}5,9.5"
        for h in range(17, 24)
        for m in range(0, 60, 5)
    ]
    (tmp_path / "pair.csv").write_text("Gmt time,Open,High,Low,Close,Volume\n" + "\n".join(lines) + "\n")
    calendar = scan_calendar(spark, str(tmp_path / "calendar_*.csv"))
    candles = scan_candles(spark, str(tmp_path / "pair.csv"), "EURUSD")
    got = curate(calendar, candles, CurationConfig(pair="EURUSD")).orderBy("datetime_gmt").collect()
    assert [r["forecast_error_diff"] for r in got] == [0.5] * 5
    # 14:00 in New York is 19:00 GMT; the first release has no earlier one
    assert got[0]["previous_value"] == "4.1%" and got[1]["previous_value"] == "4.5%"
    assert len({r["event_id"] for r in got}) == 5
    assert [r["close_released"] is None for r in got] == [False] * 5
    assert got[0]["pips_candle_0_30_after"] == 13955 - 13905


def test_command_line(spark, sf, tmp_path):
    scored_features(spark, sf).write.partitionBy("year").parquet(str(tmp_path / "features"))
    main(
        ["sweeps", "--features", str(tmp_path / "features"), "--out", str(tmp_path / "results"),
         "--aggregations", "ALL_NO_1_1_1", "--horizons", "0_30,0_90", "--directions", "max", "--models", ""]
    )
    got = spark.read.parquet(str(tmp_path / "results"))
    assert {r["sweep_buy_sell"] for r in got.collect()} == {"0_30"}
    assert got.count() == 2


def test_scan_provider(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        ",actual,country,date,forecast,forecast_error,impact,new,previous,previous_error,time\n"
        '0,2.6M,SEK,"Tuesday, March 3, 2015",,-,Low,Timber Stock,2.4M,-,05:20\n'
        '1,4.0%,NZD,"Tuesday, March 3, 2015",3.2%,u,High,Wool Price,-0.7%,d,20:10\n'
    )
    rows = scan_provider(spark, str(tmp_path / "p.csv")).orderBy("datetime")
    got = rows.select(
        F.date_format("datetime", "yyyy-MM-dd HH:mm"), "country", "forecast_error", "previous_error"
    ).collect()
    assert [tuple(r) for r in got] == [
        ("2015-03-03 05:20", "SEK", "accurate", "accurate"),
        ("2015-03-03 20:10", "NZD", "better", "worse"),
    ]


def test_gates_lose_no_row(spark, sf):
    rows = fx.releases(spark, sf)
    passed, rejected = gates.null_row_gate(rows)
    assert passed.count() + rejected.count() == rows.count()
    assert rejected.filter("reason = ''").count() == 0


def test_curate_keeps_every_release(spark, sf):
    releases = fx.clean(spark, sf)
    table = curate(fx.releases(spark, sf), fx.candles(spark, sf), gmt_input=True)
    assert table.count() == releases.count()
    assert {"total_error_diff_outlier_class", "close_25_30_after", "pips_agg_60_240_after"} <= set(table.columns)


def test_table_name():
    assert feature_table_name("USD", "EURUSD", 2007, 2018) == "features_news_USD_pair_EURUSD_2007_2018"


PAGES = [
    (1, '<ul><li>one <a href="a">A</a></li>\n<li class="x">\n two\n<a\nhref="b">B</a>\n</li></ul>'),
    (2, '</li><LI>outer <a href="c">C</a><ul><li>inner <a href="d">D</a></li></ul> end</LI></li><li>last <a href="e">E'),
    (3, '<!-- <li><a href="no">N</a></li> --><script>if (a<li>b) "</li>"</script><li/><link><li><a href="f">F</a></li>'),
    (4, None), (5, ""), (6, "no rows < at > all"), (7, "<li></li><li><</li>"),
]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_rows_of_pages_over_lines_and_nested(spark, limit):
    """Long pages are scanned in ranges, with the same rows."""
    cells = {"href": r'href="([^"]*)"', "text": r"<a[^>]*>([^<]*)"}
    df = spark.createDataFrame(PAGES, "page_id long, html string").withColumn("pos", F.lit(0))
    got = sorted(map(tuple, scan_page_rows(df, "li", cells, limit=limit).collect()))
    assert got == [
        (1, 0, "a", "A"), (1, 1, "b", "B"), (2, 0, "c", "C"), (2, 1, "e", "E"), (3, 0, "f", "F"), (7, 0, "", ""), (7, 1, "", ""),
    ]
    twice = scan_page_rows(df.union(df), "li", cells, limit=limit)
    assert sorted(map(tuple, twice.collect())) == sorted(2 * got)
    whole = scan_page_rows(df, "li", {"all": "(.*)"}, limit=limit).filter("page_id = 2 AND pos = 0").first()["all"]
    assert whole == 'outer <a href="c">C</a><ul><li>inner <a href="d">D</a></li></ul> end'
