"""Training tables and model runs over a plan of data-set variants."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.functions.flags import dummies, threshold_label
from aftershock.operators.accounting import LEDGER, Account, keep_complete, ledger
from aftershock.operators.bundles import first_of, impact_counts, weighted_bundle_sum
from aftershock.operators.encode import apply_ids, fit_ids
from aftershock.operators.gates import impact_filter, isolated_only
from aftershock.operators.impact import join_bundle_market
from aftershock.operators.lattice import bundle_lattice, bundles_of
from aftershock.operators.neighbours import knn_classify, knn_regress, nearest
from aftershock.operators.reports import best_by_score, classification_report, rmse_report
from aftershock.operators.reshape import column_difference, horizon_columns, random_split
from aftershock.operators.trees import fit_grid, with_folds
from aftershock.plans.worktable import WorkTable
from aftershock.schemas import SWEEP_RESULT
from aftershock.session import new_path, stored
from aftershock.settings import FOLDS, HORIZON_ENDS, HORIZON_STARTS, IMPACTS, NEIGHBOURS, SNAPSHOT_ENDS, TEST_SHARE

# --- fixed values: columns of a bundle ---
# Texts of results without rows to score or to fit on.
NOTHING_SCORED, NOTHING_FITTED = "no rows to score", "no rows to fit on"
BUNDLE_SUMS = (
    "forecast_error_diff_deviation",
    "forecast_error_diff_outlier_class",
    "previous_error_diff_deviation",
    "previous_error_diff_outlier_class",
    "fe_accurate",
    "fe_better",
    "fe_worse",
    "pe_accurate",
    "pe_better",
    "pe_worse",
)
BUNDLE_FIRSTS = ("year", "week", "weekday")


@dataclass(frozen=True)
class SweepSpec:
    """One row of the plan."""

    aggregation: str
    features: str = "basic"
    before: str = "included"
    horizon: str = "0_30"
    grid: str = "basic"
    direction: str = "max"

    @property
    def impact(self) -> str:
        return self.aggregation.split("_")[0]

    @property
    def isolated(self) -> bool:
        return self.aggregation.split("_")[1] == "YES"

    @property
    def weights(self) -> tuple[int, ...]:
        return tuple(int(w) for w in self.aggregation.split("_")[2:])

    @property
    def minutes(self) -> tuple[int, int]:
        start, end = self.horizon.split("_")
        return int(start), int(end)

    @property
    def sweep_id(self) -> str:
        return "-".join(
            (self.aggregation, self.features, self.before, self.horizon, self.grid, self.direction)
        )

    @property
    def target(self) -> str:
        start, end = self.minutes
        return f"pips_candle_{self.direction}_{start}_{end}_after"

    @property
    def label(self) -> str:
        start, end = self.minutes
        return f"reaction_{self.direction}_{start}_{end}_after"


def parse_sweep_spec(aggregation: Column, horizon: Column) -> dict[str, Column]:
    """Parts of the two text columns that describe a variant."""
    a, h = F.split(aggregation, "_"), F.split(horizon, "_")
    return {
        "impact_filter": a[0],
        "standalone": a[1],
        "high_weight": a[2].cast("int"),
        "medium_weight": a[3].cast("int"),
        "low_weight": a[4].cast("int"),
        "from_min": h[0].cast("int"),
        "to_min": h[1].cast("int"),
    }


def sweep_plan(
    releases: DataFrame | None,
    isolation: Sequence[str] = ("NO", "YES"),
    weights: Sequence[str] = ("1_1_1", "3_2_1"),
    features: Sequence[str] = ("basic", "all"),
    before: Sequence[str] = ("included", "excluded"),
    horizon: Sequence[str] = ("0_30", "0_60", "30_60", "30_90"),
    grid: Sequence[str] = ("basic",),
    starts: Sequence[int] = HORIZON_STARTS,
    ends: Sequence[int] = HORIZON_ENDS,
    lattice: DataFrame | None = None,
) -> DataFrame:
    """All variants for the impacts that occur, with the bundles each can train on.

    ``valid`` is false for a horizon outside the extracted ones.  The lists
    are exploded on one row per impact.  With a ``lattice`` the releases are not
    needed.
    """
    # One row per instant and impact, then per instant: hot instants fold map-side.
    per_impact = bundle_lattice(releases, ()) if lattice is None else lattice.select("datetime", "impact", "_n")
    overall = per_impact.groupBy("datetime").agg(F.sum("_n").alias("_n"))
    counted = per_impact.select("impact", "_n").unionByName(
        overall.select(F.lit("ALL").alias("impact"), "_n")
    )
    bundles = counted.groupBy("impact").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_n") == 1).alias("_single")
    )

    def each(values: Sequence[str], name: str) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    plan = bundles.select("*", each(isolation, "isolated"))
    for name, values in (
        ("weights", weights),
        ("features", features),
        ("before_data", before),
        ("horizon", horizon),
        ("grid", grid),
        ("direction", ("max", "min")),
    ):
        plan = plan.select("*", each(values, name))
    aggregation = F.concat_ws("_", "impact", "isolated", "weights")
    parts = parse_sweep_spec(aggregation, F.col("horizon"))
    valid = parts["from_min"].isin(*starts) & parts["to_min"].isin(*ends)
    return plan.select(
        F.concat_ws(
            "-", aggregation, "features", "before_data", "horizon", "grid", "direction"
        ).alias("sweep_id"),
        aggregation.alias("sweep_news_agg"),
        "features",
        "before_data",
        "horizon",
        "grid",
        "direction",
        parts["from_min"].alias("from_min"),
        parts["to_min"].alias("to_min"),
        valid.alias("valid"),
        F.when(F.col("isolated") == "YES", F.col("_single")).otherwise(F.col("_all")).alias("bundles"),
    )


def bundle_table(
    features: DataFrame,
    spec: SweepSpec,
    ids: DataFrame | None = None,
    market: Sequence[str] = (),
) -> DataFrame:
    """One row per instant: weighted sums, impact counts and date parts.

    Everything is a plain aggregate, so no list of releases is ever built.
    ``market`` names market columns to keep; they are the same for all releases
    of an instant, so any value will do and no second pass is needed.
    ``ids`` are fitted indicator ids; a bundle carries the smallest and the
    number of distinct ones.
    """
    rows = impact_filter(features, spec.impact)
    rows = rows.withColumns(
        {
            k: v
            for k, v in dummies(
                F.col("forecast_error"), F.col("previous_error"), F.col("impact")
            ).items()
            if k not in IMPACTS
        }
    )
    extra = []
    if ids is not None:
        rows = apply_ids(rows, ids, "indicator")
        extra = [
            F.min("indicator_id").alias("first_indicator_id"),
            F.countDistinct("indicator_id").alias("indicators"),
        ]
    weights = spec.weights if spec.impact == "ALL" else None
    impacts = impact_counts(IMPACTS if spec.impact == "ALL" else (spec.impact,))
    bundles = rows.groupBy("datetime").agg(
        F.count(F.lit(1)).alias("num_news"),
        *[weighted_bundle_sum(c, weights) for c in BUNDLE_SUMS],
        *impacts,
        *[first_of(c) for c in BUNDLE_FIRSTS],
        *extra,
        *[F.max(c).alias(c) for c in market],
    )
    return isolated_only(bundles) if spec.isolated else bundles


def lattice_of(features: DataFrame, market: Sequence[str] = ()) -> DataFrame:
    """The parts that bundles of all aggregations are made of, with market columns to keep."""
    flags = dummies(F.col("forecast_error"), F.col("previous_error"), F.col("impact"))
    rows = features.withColumns({k: v for k, v in flags.items() if k not in IMPACTS})
    return bundle_lattice(rows, BUNDLE_SUMS, BUNDLE_FIRSTS, market)


def lattice_dataset(lattice: DataFrame, spec: SweepSpec) -> DataFrame:
    """``sweep_dataset`` of a variant from the lattice, without another look at the releases."""
    start, end = spec.minutes
    market = market_columns(spec)
    rows = bundles_of(lattice, spec.impact, spec.weights, spec.isolated, BUNDLE_SUMS, BUNDLE_FIRSTS, market)
    label = threshold_label(F.col(spec.target), F.lit(start), F.lit(end))
    return rows.withColumn(spec.label, label)


def market_columns(spec: SweepSpec) -> list[str]:
    """Market features known when the position is opened, and the target."""
    start, _ = spec.minutes
    names = horizon_columns(
        [e for e in SNAPSHOT_ENDS if e <= start],
        [a for a in HORIZON_STARTS if 0 < a < start],
        [b for b in HORIZON_ENDS if b <= start],
        spec.features,
        spec.before == "included",
    )
    return [*names, spec.target]


def sweep_dataset(
    features: DataFrame,
    spec: SweepSpec,
    bundles: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Training table of one variant: bundles, market features, target and label.

    ``bundles`` may be shared by the variants of one aggregation.
    """
    start, end = spec.minutes
    market = market_columns(spec)
    if bundles is None:
        joined = bundle_table(features, spec, ids, market)
    else:
        joined = join_bundle_market(bundles, features, market)
    label = threshold_label(F.col(spec.target), F.lit(start), F.lit(end))
    return joined.withColumn(spec.label, label)


def feature_names(dataset: DataFrame, spec: SweepSpec) -> list[str]:
    return column_difference(dataset, [spec.target, spec.label, "datetime", "is_test", "fold"])


def vectors(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the features as an array of doubles."""
    return rows.withColumn("vector", F.array(*[F.col(c).cast("double") for c in names]))


@dataclass(frozen=True)
class SweepData:
    """Complete rows of a variant's training table; stored."""

    train: DataFrame
    test: DataFrame
    names: list[str]
    account: Account


def sweep_data(
    lattice: DataFrame, spec: SweepSpec, folds: int = FOLDS
) -> SweepData:
    """Training and test rows of a variant, with folds; rows with nulls are left out and counted."""
    dataset = with_folds(random_split(lattice_dataset(lattice, spec), "datetime", TEST_SHARE), "datetime", folds)
    rows, _, account = keep_complete(dataset, spec.sweep_id)
    return SweepData(rows.filter("is_test = 0"), rows.filter("is_test = 1"), feature_names(rows, spec), account)


def neighbour_results(data: SweepData, spec: SweepSpec, ks: Sequence[int] = NEIGHBOURS) -> DataFrame:
    """Result rows of the nearest-neighbour model, both kinds from one search for the grid and one for the test."""
    began = time.time()

    def keyed(rows: DataFrame) -> DataFrame:
        return vectors(rows, data.names).select(
            F.col("datetime").alias("id"), "vector", F.col(spec.label).alias("_clf"), F.col(spec.target).alias("_reg"), "fold"
        )

    train, test = keyed(data.train), keyed(data.test)
    inner = stored(nearest(train, train, max(ks), ["_clf", "_reg"], fold="fold"), "neighbours")
    chosen = {kind: _best_k(inner, train, kind, ks) for kind in ("clf", "reg")}
    outer = stored(nearest(test, train, max(k for k, _ in chosen.values()), ["_clf", "_reg"]), "neighbours")
    rows = []
    for kind, (k, score) in chosen.items():
        scored = _guessed(outer, test, kind, [k]).select("y", "yhat")
        rows.append(_result_row(scored, spec, "kn", kind, score, str({"n_neighbors": k}), began))
    return _result_table(data.train.sparkSession, rows)


def _guessed(found: DataFrame, rows: DataFrame, kind: str, ks: Sequence[int]) -> DataFrame:
    """``k, y, yhat`` of all rows with neighbours."""
    predict = knn_classify if kind == "clf" else knn_regress
    truth = rows.select(F.col("id").alias("test_id"), F.col(f"_{kind}").cast("double").alias("y"))
    return predict(found, f"_{kind}", ks).join(truth, "test_id").select(
        "k", "y", F.col("predicted").cast("double").alias("yhat")
    )


def _best_k(found: DataFrame, rows: DataFrame, kind: str, ks: Sequence[int]) -> tuple[int, float | None]:
    """The best k over the folds and its score."""
    scored = _guessed(found, rows, kind, ks)
    if kind == "clf":
        grid = scored.groupBy("k").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("s"))
    else:
        grid = rmse_report(scored, ["k"], "y", "yhat").withColumnRenamed("rmse", "s")
    # With fewer than two folds there is nothing to compare: smallest k, no score.
    best = best_by_score(grid.withColumn("g", F.lit(0)), ["g"], "s", ["k"], kind == "clf").first()
    return (int(best["k"]), float(best["s"])) if best else (min(ks), None)


def grid_results(
    data: SweepData, spec: SweepSpec, model: str, points: Sequence[dict], folds: int = FOLDS, parallelism: int = 4
) -> DataFrame:
    """Result rows of a tree model's grid, both kinds."""
    rows = []
    for kind, target in (("clf", spec.label), ("reg", spec.target)):
        began = time.time()
        fitted = fit_grid(data.train, data.names, target, model, kind, points, folds, parallelism)
        scored = fitted.predict(data.test).select(
            F.col(target).cast("double").alias("y"), F.col("prediction").alias("yhat")
        )
        score, params = fitted.scores[fitted.best], str(points[fitted.best])
        if fitted.model is None:
            scored, params = scored.limit(0), NOTHING_FITTED
        rows.append(_result_row(scored, spec, model, kind, score, params, began))
    return _result_table(data.train.sparkSession, rows)


def _result_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField("sweep_id", T.StringType()), *SWEEP_RESULT.fields]))


def _result_row(scored, spec, model, kind, best_score, params, began) -> tuple:
    """Values of one result row; the scores are a one-row aggregate."""
    names = [f.name for f in SWEEP_RESULT.fields][10:18]
    one = scored.withColumn("_g", F.lit(0))
    if kind == "clf":
        row = classification_report(one, ["_g"], "y", "yhat").first()
        values = [float(row[n]) if row else None for n in names]
        report = str({n: row[n] for n in names}) if row else NOTHING_SCORED
    else:
        row = rmse_report(one, ["_g"], "y", "yhat").first()
        values = [None] * len(names)
        report = f"{row['rmse']:.2f}" if row else NOTHING_SCORED
    return (
        spec.sweep_id,
        kind,
        model,
        spec.direction,
        spec.features,
        spec.aggregation,
        spec.horizon,
        spec.before,
        spec.grid,
        None if best_score is None else float(best_score),
        params,
        *values,
        report,
        round((time.time() - began) / 60, 2),
    )


def run_sweeps(
    features: DataFrame,
    specs: Sequence[SweepSpec],
    grids: dict[str, Sequence[dict]],
    path: str | None = None,
    neighbours: Sequence[int] = NEIGHBOURS,
    folds: int = FOLDS,
    parallelism: int = 4,
    workers: int = 2,
    lease_minutes: float = 0.0,
) -> DataFrame:
    """Result rows of a whole plan: one for each variant, model and kind.

    ``grids`` names tree models and their grid points; ``neighbours`` is the grid
    of the nearest-neighbour model (empty: without it).  A unit of work is a
    variant and a model.  Units are claimed, done and failed in a table in
    ``path`` (see ``worktable``), ``workers`` of them at a time: a run with other
    models adds to what is there, a killed run goes on where it was, and a failed
    unit does not keep the others from being done.  Returns what all runs into
    ``path`` have done so far.  The features are scanned once, for the lattice of all
    aggregations; the training table of a variant is made from it when its first unit
    needs it, and what rows it left out is told in ``sweep_accounts``.
    """
    spark = features.sparkSession
    work = WorkTable(spark, path or new_path(spark, "sweep-results"), lease_minutes)
    market = sorted({c for spec in specs for c in market_columns(spec)})
    once = _Once()

    def made(spec: SweepSpec) -> SweepData:
        lattice = once.get("lattice", lambda: stored(lattice_of(features, market), "lattice"))
        data = sweep_data(lattice, spec, folds)
        ledger(spark, [data.account]).write.mode("overwrite").parquet(f"{work.path}/_accounts/{spec.sweep_id}")
        return data

    def data_of(spec: SweepSpec) -> SweepData:
        return once.get(spec.sweep_id, lambda: made(spec))

    jobs: dict[str, Callable[[], DataFrame]] = {}
    for spec in specs:
        if neighbours:
            jobs[f"{spec.sweep_id}/kn"] = lambda spec=spec: neighbour_results(data_of(spec), spec, neighbours)
        for model, points in grids.items():
            jobs[f"{spec.sweep_id}/{model}"] = lambda spec=spec, model=model, points=points: grid_results(
                data_of(spec), spec, model, points, folds, parallelism
            )
    work.run_all(jobs, workers)
    return sweep_results(spark, work.path)


def sweep_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of all done units of a folder."""
    rows = WorkTable(spark, path).results()
    return _result_table(spark, []) if rows is None else rows


def sweep_accounts(spark: SparkSession, path: str) -> DataFrame:
    """``job, reason, rows`` of the training tables of a folder: rows read, kept, and left out by column."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{path}/_accounts")


class _Once:
    """Values that are made once, whichever thread asks first."""

    def __init__(self):
        self.lock, self.locks, self.values = Lock(), {}, {}

    def get(self, key, make: Callable):
        with self.lock:
            own = self.locks.setdefault(key, Lock())
        with own:
            if key not in self.values:
                self.values[key] = make()
            return self.values[key]


def fit_indicator_ids(train: DataFrame) -> DataFrame:
    """Indicator ids fitted on training rows, to be applied to both sides of a split."""
    return fit_ids(train, "indicator", "indicator_id")
