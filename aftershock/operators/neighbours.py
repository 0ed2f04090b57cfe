"""Exact k nearest neighbours by Euclidean distance, as a Voronoi join.

Comparing every test row with every training row does not scale.  Training rows
are parted into cells around pivots, about as many as the root of their number;
cells that lie together form groups, groups are cut into blocks of bounded size,
and a block travels as one matrix.  Test rows are parted by cell as well.

Each part asks for blocks twice.  The first time it takes the nearest cells that
hold ``k`` rows, of which only the distance of each row's k-th is kept.  It bounds
the second round: a cell is asked for only if, by the triangle inequality and by
the plane between its pivot and the row's own, it may hold a row that is not
farther.  Blocks are sent to just the parts that asked; a part reads them one
after the other and keeps the best rows so far, so no others leave the task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.session import stored
from aftershock.settings import NEIGHBOURS

# Workers need not be able to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pivots go to every task; beyond this many cells grow instead, and are cut into blocks.
MOST_PIVOTS = 2048
# Training rows of a block and test rows of a part, at most; a part keeps about so many neighbours.
BLOCK_ROWS, PART_ROWS, PART_FOUND = 8192, 32768, 1 << 22
# So many parts of test rows, if there are as many rows.
LEAST_PARTS = 24
# Training rows that are compared at once, and neighbours that leave a task at once.
_STEP_ROWS, _OUT_ROWS = 8192, 1 << 16
_SLACK = 1e-5
# Distances that a task holds at once.
_CELLS = 1 << 20
_ASKED = "group int, block int, part long, row binary"


@dataclass(frozen=True)
class Cells:
    """What all tasks know of the training rows; its size is bounded by the number of pivots and folds."""

    centres: np.ndarray
    group: np.ndarray  # of each cell
    near: np.ndarray  # smallest and largest distance of a cell's rows to its pivot
    far: np.ndarray
    rows: np.ndarray  # of each cell
    folds: dict[int, np.ndarray]  # rows of each cell by fold
    blocks: np.ndarray  # of each group

    def distances(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.centres)

    def usable(self, fold: np.ndarray, by_fold: bool) -> np.ndarray:
        """Rows of each cell that count for each test row."""
        if not by_fold:
            return np.broadcast_to(self.rows, (len(fold), len(self.rows)))
        none = np.zeros_like(self.rows)
        own, which = np.unique(fold, return_inverse=True)
        return (self.rows - np.stack([self.folds.get(int(f), none) for f in own]))[which]

    def first(self, d: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
        """Groups of the nearest cells that hold ``k`` rows."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(usable, order, axis=1), axis=1)
        before -= np.take_along_axis(usable, order, axis=1)
        chosen = np.zeros(d.shape, bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return self._groups(chosen & (usable > 0))

    def second(self, x: np.ndarray, d: np.ndarray, usable: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Groups of cells that may hold a row within ``reach``."""
        own = d.argmin(axis=1)
        least = np.maximum(np.maximum(d - self.far, self.near - d), 0)
        used, which = np.unique(own, return_inverse=True)
        apart = _distances(self.centres[used], self.centres)[which]
        # Distance from the plane between both pivots, for the cells behind it.
        plane = (d * d - (d * d)[np.arange(len(d)), own][:, None]) / np.maximum(2 * apart, 1e-300)
        least = np.maximum(least, np.where(apart > 0, plane, 0))
        scale = 1 + np.sqrt((x * x).sum(axis=1)) + np.sqrt((self.centres * self.centres).sum(axis=1).max())
        return self._groups((least <= (reach + _SLACK * scale)[:, None]) & (usable > 0))

    def _groups(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), len(self.blocks)), bool)
        row, cell = np.nonzero(cells)
        out[row, self.group[cell]] = True
        return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _vector_bytes(x: np.ndarray) -> bytes:
    """All numbers in a row, in half the bytes if that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else x).tobytes()


def _vectors(data: bytes, rows: int, length: int) -> np.ndarray:
    kind = "<f4" if len(data) < 8 * rows * length else "<f8"
    return np.frombuffer(data, kind).reshape(rows, length).astype(float, copy=False)


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _assigned(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """Rows with their cell and the distance to its pivot; stored."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column("_vector"))
            step = max(1, _CELLS // len(cells))
            cell, dist = [], []
            for a in range(0, len(x), step):
                d = _distances(x[a : a + step], cells)
                cell.append(d.argmin(axis=1))
                dist.append(d.min(axis=1))
            more = [pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(dist))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_cell", "_dist"])

    fields = [*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_dist", T.DoubleType())]
    return stored(rows.mapInArrow(assign, T.StructType(fields)), "cells")


def _tiles(rows: DataFrame, place: list[str], keep: list[str]) -> DataFrame:
    """The rows of each place as one row: matrix, folds and the other columns; stored."""
    fixed = ", ".join(f"{c} {t}" for c, t in rows.select(*place).dtypes)

    def pack(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        columns = {c: batch.column(c)[:1] for c in place}
        columns["vectors"] = pa.array([_vector_bytes(_matrix(batch.column("_vector")))])
        columns["fold"] = pa.array([batch.column("_fold").fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4").tobytes()])
        columns["rest"] = pa.array([_packed(batch.select(keep))])
        return pa.table(columns)

    packed = rows.groupBy(*place).applyInArrow(pack, f"{fixed}, vectors binary, fold binary, rest binary")
    return stored(packed, "tiles")


def nearest(
    test: DataFrame,
    train: DataFrame,
    k: int,
    payload: Sequence[str],
    key: str = "id",
    vector: str = "vector",
    fold: str | None = None,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest training rows of every test row.

    Both frames carry a ``key`` and a ``vector`` of doubles, all of one length
    and without nulls; ``payload`` names training columns to return.  With
    ``fold`` (an int), rows of the test row's own fold do not count.  Distances are rounded
    to 6 decimals and ties go to the smaller training key.  A test row with fewer
    than ``k`` rows to compare gets them all; an empty side gives no rows.
    Returns (test_id, rank, train_id, dist, payload...).
    """
    payload = list(payload)
    n = train.count()
    kinds = T.StructType(
        [
            T.StructField("test_id", test.schema[key].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField("dist", T.DoubleType()), T.StructField("train_id", train.schema[key].dataType),
            *[train.schema[p] for p in payload],
        ]
    )
    result = ["test_id", "rank", "train_id", "dist", *payload]
    if n == 0:  # nothing to be near to
        none = train.sparkSession.createDataFrame([], kinds)
        return none.select(*result)
    most = pivots or min(MOST_PIVOTS, math.ceil(math.sqrt(n)))
    chosen = train.select(vector).orderBy(F.xxhash64(key), key).limit(most).collect()
    centres = np.unique(np.array([r[0] for r in chosen], float), axis=0)
    by_fold, own_fold = fold is not None, F.col(fold).cast("int") if fold else F.lit(None).cast("int")

    known = train.select(
        F.col(key).alias("train_id"), F.col(vector).alias("_vector"), own_fold.alias("_fold"), *payload
    )
    known = _assigned(known, centres)
    cells = _summary(known, centres, block_rows, by_fold)
    groups = known.sparkSession.createDataFrame(
        [(i, int(g), int(cells.blocks[g])) for i, g in enumerate(cells.group)], "_cell int, group int, _blocks int"
    )
    # One row for each pivot.
    known = known.join(F.broadcast(groups), "_cell").withColumn(
        "block", F.pmod(F.xxhash64("train_id"), F.col("_blocks")).cast("int")
    )
    blocks = _tiles(known, ["group", "block"], ["train_id", *payload])

    asking = test.select(F.col(key).alias("test_id"), F.col(vector).alias("_vector"), own_fold.alias("_fold"))
    asking = _assigned(asking, centres).join(F.broadcast(groups.drop("_blocks")), "_cell")
    asking, count = _dealt(asking, k)
    parts = _tiles(asking, ["part"], ["test_id"])
    length = centres.shape[1]

    def search(parts: DataFrame, last: bool) -> DataFrame:
        met = _asked(parts.withColumnRenamed("reach", "_reach") if last else parts, cells, k, by_fold)
        sent = met.join(blocks, ["group", "block"]).withColumn("reach", F.lit(None).cast("binary"))
        columns = ["part", "group", "block", "row", "vectors", "fold", "rest", "reach"]
        own = parts if last else parts.withColumn("reach", F.lit(None).cast("binary"))
        own = own.withColumns({c: F.lit(None).cast(t) for c, t in (("group", "int"), ("block", "int"), ("row", "binary"))})
        # A part's test rows come before the blocks it asked for.
        dealt = own.select(columns).unionByName(sent.select(columns)).repartitionById(count, F.col("part").cast("int"))
        dealt = dealt.sortWithinPartitions("part", F.col("group").asc_nulls_first(), "block")
        schema = kinds if last else T.StructType.fromDDL("part long, reach binary")
        return dealt.mapInArrow(_part_search(k, by_fold, length, None if last else schema, kinds), schema)

    reach = stored(search(parts, False), "reach")
    return search(parts.join(reach, "part"), True).select(*result)


def _dealt(asking: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Test rows with the number of their part, and how many parts there are."""
    told = asking.groupBy("group").count().collect()  # as many rows as groups
    rows = min(PART_ROWS, max(1, PART_FOUND // k), math.ceil(sum(r["count"] for r in told) / LEAST_PARTS) or 1)
    sizes, count = [], 0
    for g, n in sorted(map(tuple, told)):
        sizes.append((g, count, math.ceil(n / rows)))
        count += sizes[-1][2]
    sizes = asking.sparkSession.createDataFrame(sizes, "group int, _first long, _parts int")
    sub = F.pmod(F.xxhash64("test_id", F.monotonically_increasing_id()), F.col("_parts"))
    asking = asking.join(F.broadcast(sizes), "group").withColumn("part", F.col("_first") + sub)
    return asking, max(1, count)


def _summary(known: DataFrame, centres: np.ndarray, block_rows: int, by_fold: bool) -> Cells:
    """Sizes of all cells, and the groups they form."""
    # At most (pivots x folds) rows.
    told = known.groupBy("_cell", "_fold").agg(
        F.count(F.lit(1)).alias("n"), F.max("_dist").alias("far"), F.min("_dist").alias("near")
    ).collect()
    m = len(centres)
    rows, near, far = np.zeros(m, np.int64), np.full(m, np.inf), np.zeros(m)
    folds: dict[int, np.ndarray] = {}
    for c in told:
        at = c["_cell"]
        rows[at] += c["n"]
        far[at], near[at] = max(far[at], c["far"]), min(near[at], c["near"])
        if by_fold and c["_fold"] is not None:
            folds.setdefault(c["_fold"], np.zeros(m, np.int64))[at] += c["n"]
    # A few of the pivots gather the others around them.
    heads = max(1, min(m, math.ceil(rows.sum() / block_rows)))
    picks = np.linspace(0, m - 1, heads).astype(int)
    group = _distances(centres, centres[picks]).argmin(axis=1)
    sizes = np.bincount(group, rows, heads)
    return Cells(centres, group, near, far, rows, folds, np.maximum(1, np.ceil(sizes / block_rows)).astype(np.int64))


def _asked(parts: DataFrame, cells: Cells, k: int, by_fold: bool) -> DataFrame:
    """Blocks that parts ask for and for which of their rows, in the first round or, with ``_reach``, in the second."""
    again = "_reach" in parts.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fold = np.frombuffer(batch.column("fold")[i].as_py(), "<i4")
                x = _vectors(batch.column("vectors")[i].as_py(), len(fold), cells.centres.shape[1])
                reach = np.frombuffer(batch.column("_reach")[i].as_py()) if again else None
                step = max(1, _CELLS // (4 * len(cells.centres)))
                masks = []
                for a in range(0, len(x), step):
                    part = x[a : a + step]
                    d, usable = cells.distances(part), cells.usable(fold[a : a + step], by_fold)
                    if again:
                        masks.append(cells.second(part, d, usable, reach[a : a + step]))
                    else:
                        masks.append(cells.first(d, usable, k))
                mask = np.concatenate(masks)
                for g in np.flatnonzero(mask.any(axis=0)).tolist():
                    row = [np.flatnonzero(mask[:, g]).astype("<i4").tobytes()]
                    for block in range(int(cells.blocks[g])):
                        at = [pa.array([g], pa.int32()), pa.array([block], pa.int32()), batch.column("part")[i : i + 1]]
                        yield pa.RecordBatch.from_arrays([*at, pa.array(row)], ["group", "block", "part", "row"])

    wanted = ["part", "fold", "vectors", *(["_reach"] if again else [])]
    return parts.select(wanted).mapInArrow(ask, _ASKED)


class _Best:
    """The best rows so far for each of a part's test rows, nearest first."""

    def __init__(self, k: int, by_fold: bool, x: np.ndarray, fold: np.ndarray, ids: pa.Array, reach: np.ndarray):
        self.k, self.by_fold, self.x, self.fold, self.ids, self.reach = k, by_fold, x, fold, ids, reach
        self.dist = np.full((len(x), k), np.inf)
        # Where a row is in the table of all that are among the best, with some that were.
        self.at = np.zeros((len(x), k), np.int32)
        self.rows, self.most = None, 0

    def add(self, row: np.ndarray, known: np.ndarray, folds: np.ndarray, rest: pa.RecordBatch) -> None:
        """Compares the test rows ``row`` with a block."""
        for a in range(0, len(known), _STEP_ROWS):
            b = a + _STEP_ROWS
            self._add(row, known[a:b], folds[a:b], pa.Table.from_batches([rest.slice(a, _STEP_ROWS)]))

    def _add(self, rows: np.ndarray, known: np.ndarray, folds: np.ndarray, rest: pa.Table) -> None:
        held = self.rows.num_rows if self.rows is not None else 0
        both = pa.concat_tables([self.rows, rest]) if held else rest
        place = _places(both.column("train_id"))
        squares = (known * known).sum(axis=1)
        most = math.sqrt(squares.max())
        step = max(1, _CELLS // len(known))
        for a in range(0, len(rows), step):
            row = rows[a : a + step]
            part = self.x[row]
            own = (part * part).sum(axis=1)
            # One product gives all distances, good enough to choose from.
            near = own[:, None] + squares - 2 * (part @ known.T)
            near = np.sqrt(np.maximum(near, 0, out=near), out=near)
            if self.by_fold:
                near[self.fold[row, None] == folds] = np.inf
            slack = _SLACK * (1 + np.sqrt(most * most + own))
            bound = np.minimum(self.dist[row, -1], self.reach[row]) + slack
            chosen = near <= bound[:, None]
            many = np.flatnonzero(np.count_nonzero(chosen, axis=1) > self.k)
            if len(many):
                last = np.partition(near[many], self.k - 1, axis=1)[:, self.k - 1] + slack[many]
                chosen[many] = near[many] <= np.minimum(bound[many], last)[:, None]
            chosen &= near < np.inf
            test, train = np.nonzero(chosen)
            if len(test):
                self._keep(row, test, _exact(known, train, part, test), train + held, place)
        self.rows = both
        if both.num_rows > self.most:
            used, at = np.unique(np.where(self.dist < np.inf, self.at, 0), return_inverse=True)
            self.at, self.rows = at.reshape(self.dist.shape).astype(np.int32), both.take(pa.array(used)).combine_chunks()
            self.most = 2 * len(used) + 4 * _STEP_ROWS

    def _keep(self, row: np.ndarray, test: np.ndarray, dist: np.ndarray, at: np.ndarray, place: np.ndarray) -> None:
        """Merges new rows into the best of those test rows that have some."""
        own, which = np.unique(test, return_inverse=True)
        old, k = row[own], self.k
        test = np.concatenate([np.repeat(np.arange(len(own)), k), which])
        dist = np.concatenate([self.dist[old].ravel(), dist])
        at = np.concatenate([self.at[old].ravel(), at])
        order = np.lexsort((place[at], dist, test))
        test, dist, at = test[order], dist[order], at[order]
        first = np.arange(len(test)) - np.searchsorted(test, test) < k
        self.dist[old], self.at[old] = dist[first].reshape(-1, k), at[first].reshape(-1, k)

    def found(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The best rows with their rank."""
        step = max(1, _OUT_ROWS // self.k)
        for a in range(0, len(self.x), step):
            test, rank = np.nonzero(self.dist[a : a + step] < np.inf)
            if len(test):
                taken = self.rows.take(pa.array(self.at[a : a + step][test, rank])).combine_chunks().to_batches()[0]
                columns = [self.ids.take(pa.array(test + a)), pa.array((rank + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(self.dist[a : a + step][test, rank]), *taken.columns], names
                )


def _places(keys: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the keys."""
    if pa.types.is_signed_integer(keys.type) and keys.null_count == 0:
        return keys.to_numpy()
    order = pa.compute.sort_indices(keys, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _exact(known: np.ndarray, train: np.ndarray, part: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Rounded distances of pairs of rows."""
    out, step = np.empty(len(test)), max(1, _CELLS // known.shape[1])
    for a in range(0, len(test), step):
        b = a + step
        out[a:b] = np.sqrt(((known[train[a:b]] - part[test[a:b]]) ** 2).sum(axis=1))
    return np.round(out, 6)


def _part_search(k: int, by_fold: bool, length: int, told: T.StructType | None, kinds: T.StructType):
    """Neighbours of each part's rows or, with ``told``, only the distance of the k-th."""
    names = kinds.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, best = None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if best is not None and told is None:
                yield from best.found(names)
            elif best is not None:
                columns = [pa.array([part], pa.int64()), pa.array([best.dist[:, -1].tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, told.names)

        for batch in batches:
            for i in range(batch.num_rows):
                fold = np.frombuffer(batch.column("fold")[i].as_py(), "<i4")
                x = _vectors(batch.column("vectors")[i].as_py(), len(fold), length)
                rest = _unpacked(batch.column("rest")[i].as_py())
                if batch.column("group")[i].is_valid:
                    best.add(np.frombuffer(batch.column("row")[i].as_py(), "<i4"), x, fold, rest)
                    continue
                yield from ended()
                reach = batch.column("reach")[i].as_py()
                reach = np.full(len(x), np.inf) if reach is None else np.frombuffer(reach)
                part, best = batch.column("part")[i].as_py(), _Best(k, by_fold, x, fold, rest.column("test_id"), reach)
        yield from ended()

    return search


def knn_classify(
    neighbours: DataFrame, label: str, ks: Sequence[int] = NEIGHBOURS
) -> DataFrame:
    """Majority label among the first k neighbours, for every k from one pass.

    Equal votes go to the smaller label.
    """
    votes = neighbours.groupBy("test_id", label).agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks]
    )
    # Dealt by row before there is a line for each k.
    votes = votes.repartition("test_id")
    long = votes.select("test_id", label, _by_k(ks)).select("test_id", label, "_k.*")
    order = F.struct(F.col("value"), -F.col(label))
    return long.groupBy("test_id", "k").agg(F.max_by(label, order).alias("predicted"))


def knn_regress(neighbours: DataFrame, target: str, ks: Sequence[int] = NEIGHBOURS) -> DataFrame:
    """Mean target of the first k neighbours, for every k from one pass."""
    means = neighbours.groupBy("test_id").agg(
        *[F.avg(F.when(F.col("rank") <= k, F.col(target))).alias(f"_{k}") for k in ks]
    )
    long = means.select("test_id", _by_k(ks)).select("test_id", "_k.*")
    return long.select("test_id", "k", F.round("value", 6).alias("predicted"))


def _by_k(ks: Sequence[int]) -> Column:
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("value")) for k in ks]
    return F.explode(F.array(*rows)).alias("_k")


def cross_validate(
    rows: DataFrame, label: str, fold: str, ks: Sequence[int], key: str = "id", vector: str = "vector"
) -> DataFrame:
    """Mean accuracy over the folds for every k; all folds run in one job."""
    found = nearest(rows, rows, max(ks), [label], key, vector, fold)
    predicted = knn_classify(found, label, ks)
    truth = rows.select(F.col(key).alias("test_id"), F.col(label).alias("_y"), fold)
    hits = predicted.join(truth, "test_id").groupBy("k", fold).agg(
        F.avg((F.col("predicted") == F.col("_y")).cast("double")).alias("_accuracy")
    )
    return hits.groupBy("k").agg(F.round(F.avg("_accuracy"), 6).alias("accuracy"))
