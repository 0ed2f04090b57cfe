"""Fit on the past, score what came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.flags import threshold_label
from aftershock.operators.accounting import Account, keep_complete
from aftershock.operators.impact import join_predictions
from aftershock.operators.neighbours import knn_classify, knn_regress, nearest
from aftershock.operators.reports import classification_report, rmse_report
from aftershock.operators.reshape import temporal_split
from aftershock.plans.sweeps import (
    SweepSpec,
    feature_names,
    fit_indicator_ids,
    sweep_dataset,
    vectors,
)
from aftershock.session import stored


def score_new(features: DataFrame, cut: Column, spec: SweepSpec, k: int = 11) -> DataFrame:
    """All feature rows with the predictions for the instants from ``cut`` on.

    Indicator ids are fitted on the rows before the cut and reused after it.
    Instants with a null feature are not scored; ``score_accounted`` tells how many.
    """
    return score_accounted(features, cut, spec, k)[0]


def score_accounted(
    features: DataFrame, cut: Column, spec: SweepSpec, k: int = 11
) -> tuple[DataFrame, list[Account]]:
    """As above, with the accounts of the instants to learn from and of those to score."""
    features = stored(features, "features")
    train, test = temporal_split(features, cut)
    ids = fit_indicator_ids(train)
    fitted, _, learnt = keep_complete(sweep_dataset(train, spec, ids=ids), "learn")
    names = feature_names(fitted, spec)
    later, _, scored = keep_complete(sweep_dataset(test, spec, ids=ids), "score", names)
    known = vectors(fitted, names).select(
        F.col("datetime").alias("id"), "vector", spec.label, spec.target
    )
    asked = vectors(later, names).select(F.col("datetime").alias("id"), "vector")
    found = stored(nearest(asked, known, k, [spec.label, spec.target]), "neighbours")
    classes = knn_classify(found, spec.label, [k]).select(
        F.col("test_id").alias("datetime"), F.col("predicted").alias(f"{spec.label}_predicted")
    )
    pips = knn_regress(found, spec.target, [k]).select(
        F.col("test_id").alias("datetime"), F.col("predicted").alias(f"{spec.target}_predicted")
    )
    return join_predictions(features, classes.join(pips, "datetime")), [learnt, scored]


def score_report(scored: DataFrame, spec: SweepSpec) -> DataFrame:
    """Classification report and RMSE of what ``score_new`` has scored, one row.

    Counts every scored instant with a known target once.
    """
    start, end = spec.minutes
    target = F.col(spec.target)
    instants = scored.groupBy("datetime").agg(
        F.max(spec.target).alias(spec.target),
        F.max(f"{spec.label}_predicted").alias("yhat"),
        F.max(f"{spec.target}_predicted").alias("yhat_pips"),
    )
    rows = instants.filter(target.isNotNull() & F.col("yhat").isNotNull()).withColumns(
        {"y": threshold_label(target, F.lit(start), F.lit(end)), "sweep_id": F.lit(spec.sweep_id)}
    )
    rows = stored(rows, "scored")
    classes = classification_report(rows, ["sweep_id"], "y", "yhat")
    pips = rmse_report(rows.withColumn("pips", target.cast("double")), ["sweep_id"], "pips", "yhat_pips")
    return classes.join(pips, "sweep_id")
