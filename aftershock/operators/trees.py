"""Grid search over tree models.

Decision trees are grown for all points and folds together (see ``tree_levels``).
Forests and boosted chains are MLlib's.  The first trees of a forest or chain are a
smaller one, and a tree cut off at a depth is a tree of that depth, so these are
fitted once for each combination of the other parameters, with the largest depth
and number of trees, and all points are scored from that model's nodes in one pass
over the held-out rows.  A forest cut off this way is not the one that MLlib would
grow with the smaller values, whose draws depend on them, but one of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators import tree_levels
from aftershock.operators.reshape import fold_of
from aftershock.session import new_path
from aftershock.settings import FOLDS

SEED = 42
_MODELS = {
    ("rforest", "clf"): RandomForestClassifier,
    ("rforest", "reg"): RandomForestRegressor,
    ("gboosting", "clf"): GBTClassifier,
    ("gboosting", "reg"): GBTRegressor,
}
# Parameters whose smaller values are parts of the largest one's model.
_DEPTH, _COUNTS = "maxDepth", ("numTrees", "maxIter")


def grid_points(**values: Sequence) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(values, point, strict=True)) for point in product(*values.values())]


def with_folds(rows: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """Adds a reproducible fold number."""
    return rows.withColumn("fold", fold_of(F.col(key), folds))


@dataclass(frozen=True)
class GridFit:
    """Outcome of a grid search."""

    points: Sequence[dict]
    scores: Sequence[float | None]
    best: int
    model: Model | Column | None
    assembler: VectorAssembler
    # Rows with and without a null feature or target.
    fitted_rows: int
    left_out_rows: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """All rows with a ``prediction`` of the best model.

        Null where a feature is null, and everywhere if there were no rows to fit on.
        """
        if self.model is None:
            return rows.withColumn("prediction", F.lit(None).cast("double"))
        if isinstance(self.model, Column):
            return rows.withColumn("prediction", self.model)
        names = self.assembler.getInputCols()
        known = F.lit(True)
        for f in names:
            known = known & F.col(f"`{f}`").isNotNull()
        filled = {f"_in{i}": F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for i, f in enumerate(names)}
        assembler = VectorAssembler(inputCols=list(filled), outputCol="features")
        scored = self.model.transform(assembler.transform(rows.withColumns(filled)))
        return scored.select(*rows.columns, F.when(known, F.col("prediction")).alias("prediction"))


@dataclass(frozen=True)
class Nodes:
    """The nodes of a model's trees as arrays; its size is bounded by the grid, not by the data."""

    kind: str
    boosted: bool
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # per node: class shares, or the prediction
    weights: np.ndarray  # per tree

    @staticmethod
    def of(model: Model, name: str, kind: str, spark: SparkSession) -> Nodes:
        path = new_path(spark, "trees")
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        rows = data.select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"], ignore_index=True)
        first = rows.groupby("treeID").size().cumsum().shift(fill_value=0)
        base = rows["treeID"].map(first).to_numpy()
        leaf = rows["leftChild"].to_numpy() < 0
        here = np.arange(len(rows))
        split = rows["split"]
        weights = np.ones(len(first))
        if name == "gboosting":
            told = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").orderBy("tree").toPandas()
            weights = told["weight"].to_numpy()
        if kind == "clf" and name != "gboosting":
            counts = np.stack(rows["impurityStats"].to_list())
            value = counts / counts.sum(axis=1, keepdims=True)
        else:
            value = rows["prediction"].to_numpy()[:, None]
        return Nodes(
            kind,
            name == "gboosting",
            first.to_numpy(),
            np.where(leaf, 0, [s["featureIndex"] for s in split]),
            np.array([s["leftCategoriesOrThreshold"][0] if not end else np.inf for s, end in zip(split, leaf, strict=True)]),
            np.where(leaf, here, base + rows["leftChild"].to_numpy()),
            np.where(leaf, here, base + rows["rightChild"].to_numpy()),
            value,
            weights,
        )

    def predictions(self, x: np.ndarray, depth: int, counts: Sequence[int]) -> list[np.ndarray]:
        """Predictions of the first trees, for every number of trees, cut off at a depth."""
        total = np.zeros((len(x), self.value.shape[1]))
        rows, out = np.arange(len(x)), {}
        for tree in range(max(counts)):
            node = np.full(len(x), self.roots[tree])
            for _ in range(depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.weights[tree] * self.value[node]
            if tree + 1 in counts:
                out[tree + 1] = self._decide(total, tree + 1)
        return [out[n] for n in counts]

    def _decide(self, total: np.ndarray, trees: int) -> np.ndarray:
        if self.kind == "clf":
            return (total[:, 0] > 0).astype(float) if self.boosted else total.argmax(axis=1).astype(float)
        return total[:, 0] / (1 if self.boosted else trees)


def fit_grid(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    model: str,
    kind: str,
    points: Sequence[dict],
    folds: int = FOLDS,
    parallelism: int = 4,
) -> GridFit:
    """Cross-validated grid search; ``train`` carries a ``fold`` column.

    ``kind`` is ``clf`` (scored by accuracy; decision trees take classes 0 and 1)
    or ``reg`` (by RMSE).  Give it a stored table, it is read many times.
    Rows with a null feature or target are counted and left out.  The folds are
    plain filters; MLlib's fits are cluster jobs, ``parallelism`` of them at a time.  With
    rows in fewer than two folds there are no scores and the first point is
    fitted; without rows there is no model.
    """
    spark = train.sparkSession
    columns = [*features, target]
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(f"`{c}`").isNotNull()
    sizes = train.agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("lost")).first()
    train = train.filter(whole)
    if model == "dtree":
        return _fit_trees(train, features, target, kind, points, folds, sizes["kept"], sizes["lost"])
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = _MODELS[model, kind](featuresCol="features", labelCol=target, seed=SEED)
    plain = train.select(*[F.col(f).cast("double").alias(f) for f in features], target, "fold")
    plain = plain.cache()
    rows = assembler.transform(plain).select("features", target, "fold").cache()
    used = [r[0] for r in rows.select("fold").distinct().collect() if r[0] < folds]

    def fit(data: DataFrame, point: dict) -> Model:
        return learner.copy({learner.getParam(n): v for n, v in point.items()}).fit(data)

    # Points by what has to be fitted anew, each with the largest depth and count.
    groups: dict[tuple, list[int]] = {}
    for place, point in enumerate(points):
        rest = tuple(sorted((n, v) for n, v in point.items() if n != _DEPTH and n not in _COUNTS))
        groups.setdefault(rest, []).append(place)

    def score(task: tuple[tuple, int]) -> dict[int, float]:
        rest, fold = task
        places = groups[rest]
        largest = dict(rest) | {
            n: max(points[p][n] for p in places) for n in (_DEPTH, *_COUNTS) if n in points[places[0]]
        }
        fitted = fit(rows.filter(F.col("fold") != fold), largest)
        nodes = Nodes.of(fitted, model, kind, spark)
        return _scores(nodes, plain.filter(F.col("fold") == fold), features, target, points, places)

    means: list[float | None] = [None] * len(points)
    best = 0
    if len(used) > 1:
        tasks = [(rest, fold) for rest in groups for fold in used]
        sums = [0.0] * len(points)
        with ThreadPoolExecutor(parallelism) as pool:
            for found in pool.map(score, tasks):
                for place, value in found.items():
                    sums[place] += value
        means = [s / len(used) for s in sums]
        best = means.index(max(means) if kind == "clf" else min(means))
    chosen = fit(rows, points[best]) if used else None
    rows.unpersist()
    plain.unpersist()
    return GridFit(points, means, best, chosen, assembler, sizes["kept"], sizes["lost"])


# Defaults of a decision tree.
_TREE_DEPTH, _TREE_LEAF = 5, 1


def _fit_trees(
    train: DataFrame, features: Sequence[str], target: str, kind: str, points: Sequence[dict], folds: int, kept: int, lost: int
) -> GridFit:
    """The grid of decision trees: one pass for each level, one for the scores."""
    names, assembler = list(features), VectorAssembler(inputCols=list(features), outputCol="features")
    places = [(p.get("minInstancesPerNode", _TREE_LEAF), p.get(_DEPTH, _TREE_DEPTH)) for p in points]
    leaves, depths = sorted({m for m, _ in places}), sorted({d for _, d in places})
    if not kept:
        return GridFit(points, [None] * len(points), 0, None, assembler, kept, lost)
    edges = tree_levels.bin_edges(train, names)
    rows = tree_levels.binned(train, names, target, edges)
    used = sorted(r[0] for r in rows.select("fold").distinct().collect() if r[0] is not None and r[0] < folds)
    scored = used if len(used) > 1 else []
    trees = tree_levels.grow(rows, edges, scored, leaves, max(depths), kind)
    means: list[float | None] = [None] * len(points)
    best = 0
    if scored:
        told = tree_levels.held_out_errors(rows, trees, leaves, depths, kind).collect()
        mean = {(r["fold"], r["leaf"], r["depth"]): r["total"] / r["n"] for r in told}
        for i, (leaf, depth) in enumerate(places):
            each = [mean[f, leaf, depth] for f in scored]
            means[i] = float(np.mean(each if kind == "clf" else np.sqrt(each)))
        best = means.index(max(means) if kind == "clf" else min(means))
    chosen = trees.expression(names, tree_levels.ALL_ROWS, *places[best])
    return GridFit(points, means, best, chosen, assembler, kept, lost)


def _scores(
    nodes: Nodes, rows: DataFrame, features: Sequence[str], target: str, points: Sequence[dict], places: list[int]
) -> dict[int, float]:
    """Accuracy or RMSE of every point on the rows, from one pass."""
    names, deepest = list(features), 30
    wanted: dict[int, list[tuple[int, int]]] = {}
    for p in places:
        count = next((points[p][n] for n in _COUNTS if n in points[p]), len(nodes.roots))
        wanted.setdefault(points[p].get(_DEPTH, deepest), []).append((min(count, len(nodes.roots)), p))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = batch[names].to_numpy(), batch[target].to_numpy(dtype=float)
            out = []
            for depth, asked in wanted.items():
                counts = sorted({c for c, _ in asked})
                found = dict(zip(counts, nodes.predictions(x, depth, counts), strict=True))
                for count, place in asked:
                    miss = (found[count] == y) if nodes.kind == "clf" else (found[count] - y) ** 2
                    out.append((place, len(y), float(miss.sum())))
            yield pd.DataFrame(out, columns=["place", "n", "total"])

    sums = rows.mapInPandas(evaluate, "place int, n long, total double").groupBy("place")
    found = sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    mean = {r["place"]: r["total"] / r["n"] for r in found}
    return mean if nodes.kind == "clf" else {p: float(np.sqrt(v)) for p, v in mean.items()}


def grid_table(spark: SparkSession, fitted: GridFit) -> DataFrame:
    """Mean fold score of every grid point."""
    rows = [
        (str(dict(sorted(point.items()))), None if score is None else float(score))
        for point, score in zip(fitted.points, fitted.scores, strict=True)
    ]
    return spark.createDataFrame(rows, "params string, score double")
