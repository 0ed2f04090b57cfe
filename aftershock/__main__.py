"""Command line: curate features, run sweeps, score new releases.

    spark-submit --py-files aftershock.zip aftershock/__main__.py curate --help
    python -m aftershock sweeps --features curated/features --out results
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aftershock import settings
from aftershock.operators.trees import grid_points
from aftershock.plans.curation import curate
from aftershock.plans.scoring import score_new, score_report
from aftershock.plans.sweeps import SweepSpec, run_sweeps
from aftershock.sources.calendar import scan_calendar
from aftershock.sources.candles import scan_candles
from aftershock.sources.tables import scan_features, sink_features, sink_predictions

LOG = logging.getLogger("aftershock")

FULL_GRIDS = {
    "dtree": {"maxDepth": settings.TREE_DEPTHS, "minInstancesPerNode": settings.LEAF_ROWS},
    "rforest": {
        "maxDepth": settings.TREE_DEPTHS,
        "minInstancesPerNode": settings.LEAF_ROWS,
        "numTrees": settings.TREE_COUNTS,
    },
    "gboosting": {"maxIter": settings.BOOST_ROUNDS},
}


def _words(text: str) -> list[str]:
    return [w for w in text.split(",") if w]


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(w) for w in _words(text))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aftershock")
    jobs = p.add_subparsers(dest="job", required=True)

    c = jobs.add_parser("curate", help="calendar and candle files to curated features")
    c.add_argument("--calendar", required=True, help="path or glob of yearly files")
    c.add_argument("--candles", required=True)
    c.add_argument("--pair", required=True)
    c.add_argument("--currency", default="USD")
    c.add_argument("--snapshots", type=_numbers, default=settings.SNAPSHOT_ENDS)
    c.add_argument("--starts", type=_numbers, default=settings.HORIZON_STARTS)
    c.add_argument("--ends", type=_numbers, default=settings.HORIZON_ENDS)
    c.add_argument("--dst", choices=("ON", "OFF"), default="ON")
    c.add_argument("--weeks", type=int, help="distinct weeks a year must have")
    c.add_argument("--exempt-years", type=_numbers, default=())
    c.add_argument("--out", required=True)
    c.add_argument("--csv", help="also export as text")

    s = jobs.add_parser("sweeps", help="train and compare models over data-set variants")
    s.add_argument("--features", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--aggregations", type=_words, default=list(settings.VARIANT_ORDER))
    s.add_argument("--horizons", type=_words, default=["0_30"])
    s.add_argument("--market", type=_words, default=["basic"])
    s.add_argument("--before", type=_words, default=["included"])
    s.add_argument("--directions", type=_words, default=["max", "min"])
    s.add_argument("--models", type=_words, default=list(FULL_GRIDS))
    s.add_argument("--neighbours", type=_numbers, default=settings.NEIGHBOURS)
    s.add_argument("--folds", type=int, default=settings.FOLDS)
    s.add_argument("--parallelism", type=int, default=4)

    n = jobs.add_parser("score", help="fit before a date, predict from it on")
    n.add_argument("--features", required=True)
    n.add_argument("--cut", required=True, help="first date to predict")
    n.add_argument("--out", required=True)
    n.add_argument("--aggregation", default="ALL_NO_1_1_1")
    n.add_argument("--horizon", default="0_30")
    n.add_argument("--direction", default="max")
    return p


def _curate(spark: SparkSession, a: argparse.Namespace) -> None:
    config = settings.CurationConfig(
        currency=a.currency,
        pair=a.pair,
        snapshot_ends=a.snapshots,
        starts=a.starts,
        ends=a.ends,
        dst_correction=a.dst == "ON",
        expected_weeks=a.weeks,
        exempt_years=a.exempt_years,
    )
    candles = scan_candles(spark, a.candles, a.pair)
    sink_features(curate(scan_calendar(spark, a.calendar), candles, config), a.out, a.csv)


def _sweeps(spark: SparkSession, a: argparse.Namespace) -> None:
    valid = {f"{x}_{y}" for x, y in settings.horizons()}
    for horizon in set(a.horizons) - valid:
        LOG.error("no such horizon: %s", horizon)
    specs = [
        SweepSpec(aggregation, market, before, horizon, "basic", direction)
        for aggregation in a.aggregations
        for market in a.market
        for before in a.before
        for horizon in a.horizons
        if horizon in valid
        for direction in a.directions
    ]
    grids = {m: grid_points(**FULL_GRIDS[m]) for m in a.models}
    run_sweeps(
        scan_features(spark, a.features),
        specs,
        grids,
        a.out,
        neighbours=a.neighbours,
        folds=a.folds,
        parallelism=a.parallelism,
    )


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    spec = SweepSpec(a.aggregation, horizon=a.horizon, direction=a.direction)
    cut = F.lit(a.cut).cast("timestamp")
    scored = score_new(scan_features(spark, a.features), cut, spec)
    sink_predictions(scored, a.out)
    score_report(spark.read.parquet(a.out), spec).show(truncate=False, vertical=True)


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("aftershock").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    {"curate": _curate, "sweeps": _sweeps, "score": _score}[a.job](spark, a)


if __name__ == "__main__":
    main()
