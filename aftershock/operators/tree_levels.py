"""Decision trees for all folds and leaf sizes of a grid, grown level by level.

Features are binned once.  Each level is one aggregate over the rows: sums by node,
feature and bin, for the trees of all folds at once; trees that have split alike so
far share their nodes.  The best splits are chosen from these sums, for every leaf
size.  A tree of some depth holds those of smaller depths, so one more pass scores
all points of the grid on the rows of the fold that was left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.session import stored

# Workers need not be able to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
# Rank error of the bins' bounds: one in as many rows.
_ACCURACY = 40_000
# The fold of the trees that leave no rows out.
ALL_ROWS = -1
_SUMS = "node int, feature int, bin int, n long, s1 double, s2 double"


@dataclass
class Trees:
    """Nodes of the trees of all folds; at most (folds x leaf sizes x 2 ** depth) of them."""

    edges: list[np.ndarray]
    roots: dict[int, int] = field(default_factory=dict)  # of each fold
    splits: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # feature, bin, left, right
    chosen: dict[tuple[int, int], int] = field(default_factory=dict)  # number of the split by node and leaf size
    value: dict[int, float] = field(default_factory=dict)
    level: dict[int, int] = field(default_factory=dict)

    def add(self, level: int, value: float | None = None) -> int:
        node = len(self.level)
        self.level[node] = level
        if value is not None:
            self.value[node] = value
        return node

    def path(self, fold: int, leaf: int, depth: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Split nodes of a tree: node, feature, bin, left, right."""
        todo = [self.roots[fold]]
        while todo:
            node = todo.pop()
            at = self.chosen.get((node, leaf))
            if at is not None and self.level[node] < depth:
                split = self.splits[node][at]
                yield (node, *split)
                todo += split[2:]

    def expression(self, features: Sequence[str], fold: int, leaf: int, depth: int) -> Column:
        """The tree as a column; null where a feature is null."""
        splits = {s[0]: s[1:] for s in self.path(fold, leaf, depth)}

        def of(node: int) -> Column:
            if node not in splits:
                return F.lit(float(self.value[node]))
            f, b, left, right = splits[node]
            return F.when(F.col(f"`{features[f]}`") <= float(self.edges[f][b]), of(left)).otherwise(of(right))

        known = F.lit(True)
        for f in features:
            known = known & F.col(f"`{f}`").isNotNull()
        return F.when(known, of(self.roots[fold]))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins - 1`` values of each feature that splits are made at: value <= edge goes left."""
    shares = [i / bins for i in range(1, bins)]
    told = rows.agg(
        *[F.percentile_approx(F.col(f"`{f}`"), shares, _ACCURACY).alias(f"_at{i}") for i, f in enumerate(features)],
        *[F.max(F.col(f"`{f}`")).alias(f"_most{i}") for i, f in enumerate(features)],
    ).first()
    out = []
    for i in range(len(features)):
        edges = np.unique(np.array(told[f"_at{i}"] or [], float))
        out.append(edges[edges < told[f"_most{i}"]] if len(edges) else edges)
    return out


def binned(rows: DataFrame, features: Sequence[str], target: str, edges: list[np.ndarray]) -> DataFrame:
    """``fold, y, bins`` (one byte a feature) of the rows; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((batch.num_rows, len(edges)), np.uint8)
            for i, e in enumerate(edges):
                bins[:, i] = np.searchsorted(e, batch.column(f"_x{i}").to_numpy(zero_copy_only=False))
            rows_ = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), rows_], ["fold", "y", "bins"])

    plain = rows.select(
        F.col("fold").cast("int").alias("fold"), F.col(f"`{target}`").cast("double").alias("y"),
        *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
    )
    return stored(plain.mapInArrow(run, "fold int, y double, bins binary"), "binned")


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return batch.column("fold").to_numpy(), batch.column("y").to_numpy(), bins


def level_sums(rows: DataFrame, trees: Trees, level: int, bins: int = BINS) -> DataFrame:
    """Sums of the rows in every open node of a level, by feature and bin: ``n``, of y, of its squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        width = 0
        for batch in batches:
            fold, y, x = _batch(batch)
            width = x.shape[1]
            cell = x + np.arange(width) * bins  # place of each value in a node's table
            todo = [(root, np.flatnonzero(fold != held)) for held, root in trees.roots.items()]
            while todo:
                node, at = todo.pop()
                if len(at) == 0:
                    continue
                if trees.level[node] == level:
                    flat, times = cell[at].ravel(), np.repeat(y[at], width)
                    told = [np.bincount(flat, w, width * bins) for w in (None, times, times * times)]
                    sums[node] = sums.get(node, 0) + np.stack([t.astype(float) for t in told])
                    continue
                for f, b, left, right in trees.splits.get(node, ()):
                    goes = x[at, f] <= b
                    todo += [(left, at[goes]), (right, at[~goes])]
        for node, told in sums.items():
            used = np.flatnonzero(told[0])
            columns = [np.full(len(used), node, np.int32), (used // bins).astype(np.int32), (used % bins).astype(np.int32)]
            columns += [told[0][used].astype(np.int64), told[1][used], told[2][used]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "feature", "bin", "n", "s1", "s2"])

    sums = [F.sum(c).alias(c) for c in ("n", "s1", "s2")]
    return rows.mapInArrow(run, _SUMS).groupBy("node", "feature", "bin").agg(*sums)


def best_splits(sums: DataFrame, leaves: Sequence[int], kind: str) -> DataFrame:
    """The best split of every node for every leaf size, if there is one that gains anything.

    ``clf`` (y 0 or 1) weighs by the Gini index, ``reg`` by the variance; of
    equal gains (to ten decimals) the smaller feature and bin count.  Columns:
    ``node, leaf, feature, bin, gain, n, s1`` and the left side's ``ln, ls1``.
    """
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = {f"l{c}": F.sum(c).over(upto) for c in ("n", "s1", "s2")} | {f"a{c}": F.sum(c).over(by) for c in ("n", "s1", "s2")}

    def spread(n: str, s1: str, s2: str) -> str:
        return f"2 * ({s1}) * (({n}) - ({s1})) / ({n})" if kind == "clf" else f"({s2}) - ({s1}) * ({s1}) / ({n})"

    cuts = sums.withColumns(both).filter("ln < an")
    right = spread("an - ln", "as1 - ls1", "as2 - ls2")
    gain = F.expr(f"round(({spread('an', 'as1', 'as2')} - ({spread('ln', 'ls1', 'ls2')}) - ({right})) / an, 10)")
    cuts = cuts.withColumn("gain", gain).filter("gain > 0")
    sizes = F.explode(F.filter(F.array(*[F.lit(m) for m in leaves]), lambda m: m <= F.least("ln", F.expr("an - ln"))))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    kept = F.struct("feature", "bin", "gain", F.col("an").alias("n"), F.col("as1").alias("s1"), "ln", "ls1")
    return cuts.withColumn("leaf", sizes).groupBy("node", "leaf").agg(F.max_by(kept, order).alias("_s")).select("node", "leaf", "_s.*")


def _value(n: float, s1: float, kind: str) -> float:
    """Prediction of a node: the class of most rows, equal ones the smaller, or the mean."""
    return float(2 * s1 > n) if kind == "clf" else s1 / n


def grow(rows: DataFrame, edges: list[np.ndarray], folds: Sequence[int], leaves: Sequence[int], depth: int, kind: str) -> Trees:
    """Trees without each of ``folds`` in turn, and of all rows, for every leaf size; ``rows`` from ``binned``."""
    trees = Trees(edges)
    totals = {
        r["fold"]: (r["n"], r["s1"])
        for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s1")).collect()
    }
    for held in (*folds, ALL_ROWS):
        n, s1 = (sum(t[i] for f, t in totals.items() if f != held) for i in (0, 1))
        if n:
            trees.roots[held] = trees.add(0, _value(n, s1, kind))
    open_ = {(root, m) for root in trees.roots.values() for m in leaves}
    for level in range(depth):
        if not open_:
            break
        found = best_splits(level_sums(rows, trees, level), leaves, kind).collect()
        following = set()
        for s in sorted(found, key=lambda r: (r["node"], r["leaf"])):
            node, leaf = s["node"], s["leaf"]
            if (node, leaf) not in open_:
                continue
            known = trees.splits.setdefault(node, [])
            at = next((i for i, k in enumerate(known) if k[:2] == (s["feature"], s["bin"])), None)
            if at is None:
                sides = ((s["ln"], s["ls1"]), (s["n"] - s["ln"], s["s1"] - s["ls1"]))
                children = [trees.add(level + 1, _value(*side, kind)) for side in sides]
                at = len(known)
                known.append((s["feature"], s["bin"], *children))
            trees.chosen[node, leaf] = at
            following |= {(child, leaf) for child in known[at][2:]}
        open_ = following
    return trees


def held_out_errors(rows: DataFrame, trees: Trees, leaves: Sequence[int], depths: Sequence[int], kind: str) -> DataFrame:
    """``fold, leaf, depth, n, total`` of every point's trees on the rows of the fold they left out.

    ``total`` counts right classes, or sums squared errors.
    """
    trees_of = {
        (held, leaf): {s[0]: s[1:] for s in trees.path(held, leaf, max(depths))}
        for held in trees.roots for leaf in leaves if held != ALL_ROWS
    }
    size = len(trees.level)
    value = np.array([trees.value[i] for i in range(size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, list] = {}
        for batch in batches:
            fold, y, x = _batch(batch)
            for (held, leaf), splits in trees_of.items():
                at = np.flatnonzero(fold == held)
                if len(at) == 0:
                    continue
                # Leaves point at themselves.
                f, b, left, right = np.zeros(size, int), np.zeros(size, int), np.arange(size), np.arange(size)
                for node, s in splits.items():
                    f[node], b[node], left[node], right[node] = s
                node = np.full(len(at), trees.roots[held])
                for depth in range(max(depths) + 1):
                    if depth in depths:
                        miss = value[node] == y[at] if kind == "clf" else (value[node] - y[at]) ** 2
                        told = out.setdefault((held, leaf, depth), [0, 0.0])
                        told[0] += len(at)
                        told[1] += float(miss.sum())
                    node = np.where(x[at, f[node]] <= b[node], left[node], right[node])
        keys = list(out)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        columns += [pa.array([out[k][0] for k in keys], pa.int64()), pa.array([out[k][1] for k in keys], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "leaf", "depth", "n", "total"])

    told = rows.mapInArrow(run, "fold int, leaf int, depth int, n long, total double")
    return told.groupBy("fold", "leaf", "depth").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
