"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1)


def _ratio(part: Column, whole: Column) -> Column:
    """0 when nothing was counted, as a score report shows it."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def classification_report(
    scores: DataFrame, keys: Sequence[str] = ("sweep_id",), y: str = "y", guess: str = "yhat"
) -> DataFrame:
    """Precision, recall, f1 and support per class, with micro and weighted averages.

    One aggregation per key; the confusion counts combine map-side.
    """
    hit = {c: F.count_if((F.col(y) == c) & (F.col(guess) == c)).alias(f"_hit{c}") for c in CLASSES}
    said = {c: F.count_if(F.col(guess) == c).alias(f"_said{c}") for c in CLASSES}
    real = {c: F.count_if(F.col(y) == c).alias(f"_real{c}") for c in CLASSES}
    counts = scores.groupBy(*keys).agg(*hit.values(), *said.values(), *real.values())
    total = sum((F.col(f"_real{c}") for c in CLASSES), F.lit(0))
    precision = {c: _ratio(F.col(f"_hit{c}"), F.col(f"_said{c}")) for c in CLASSES}
    recall = {c: _ratio(F.col(f"_hit{c}"), F.col(f"_real{c}")) for c in CLASSES}
    f1 = {c: _ratio(2.0 * F.col(f"_hit{c}"), F.col(f"_said{c}") + F.col(f"_real{c}")) for c in CLASSES}

    def weighted(metric: dict[int, Column]) -> Column:
        return _ratio(sum((metric[c] * F.col(f"_real{c}") for c in CLASSES), F.lit(0.0)), total)

    micro = _ratio(sum((F.col(f"_hit{c}") for c in CLASSES), F.lit(0)), total)
    out = {"f1_microavg": micro}
    out["precision_weighted"] = weighted(precision)
    out["recall_weighted"] = weighted(recall)
    out["f1_weighted"] = weighted(f1)
    for c, side in zip(CLASSES, ("below_TH", "above_TH"), strict=True):
        out[f"precision_{side}"] = precision[c]
        out[f"recall_{side}"] = recall[c]
        out[f"f1_{side}"] = f1[c]
    shown = [F.round(col, 6).alias(name) for name, col in out.items()]
    support = [
        F.col(f"_real{c}").alias(f"support_{side}")
        for c, side in zip(CLASSES, ("below_TH", "above_TH"), strict=True)
    ]
    return counts.select(*keys, *shown, *support)


def rmse_report(
    scores: DataFrame,
    keys: Sequence[str] = ("sweep_id",),
    y: str = "y_reg",
    guess: str = "yhat_reg",
) -> DataFrame:
    """Root of the mean squared error per key."""
    error = F.col(y) - F.col(guess)
    return scores.groupBy(*keys).agg(F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))


def best_by_score(
    grid: DataFrame,
    keys: Sequence[str],
    score: str,
    params: Sequence[str],
    larger_is_better: bool = True,
) -> DataFrame:
    """Best grid point per key; equal scores go to the smallest parameters."""
    value = F.col(score) if larger_is_better else -F.col(score)
    point = F.struct((-value).alias("_rank"), *params)
    best = grid.groupBy(*keys).agg(F.min(point).alias("_best"))
    sign = -1 if larger_is_better else 1
    return best.select(
        *keys, (F.col("_best._rank") * sign).alias(score), *[F.col(f"_best.{p}") for p in params]
    )


def vote_ensemble(
    predictions: DataFrame, keys: Sequence[str], guess: str = "yhat", name: str = "vote"
) -> DataFrame:
    """Most frequent prediction per row over several models; ties go to the smaller class."""
    counts = predictions.groupBy(*keys, guess).agg(F.count(F.lit(1)).alias("_votes"))
    order = F.struct(F.col("_votes"), -F.col(guess))
    return counts.groupBy(*keys).agg(F.max_by(guess, order).alias(name))


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Result tables on top of each other; a missing column becomes null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
