"""Approximate nearest neighbours by cosine with a tree of k-means splits.

The tree is fitted on a bounded sample and sent to the tasks.  Every row is put
into a leaf.  A query walks the tree best bin first: a priority queue over all
branches not yet taken, nearest centre first, until it has visited as many
leaves as a calibration found to be enough, and goes on if they hold too few
rows for its neighbours.  The calibration compares sample queries with an exact
search over all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import join_measured, store
from aftershock.llm.tiles import (
    FOUND,
    HELD_CELLS,
    TILE_BYTES,
    BestLists,
    best_in_parts,
    best_of_tile,
    enough_copies,
    grid,
    matrices,
    merge_best,
    pack,
    unpack,
)

# Rows that a tree is fitted on, at most, and their bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
# Queries of the calibration, and the share of true neighbours it has to find.
CALIBRATION_QUERIES, TARGET_RECALL = 200, 0.95
BRANCHES, LEAF_ROWS, ROUNDS = 16, 256, 12
# Of a block of queries; wanted: a bit for each leaf.
_ASKED = ("ids", "uids", "data", "wanted")


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of huge or tiny components stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Nodes in breadth-first order; children of a node lie side by side."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes

    @staticmethod
    def fit(sample: np.ndarray, seed: int = 7) -> Tree:
        sample, rng = _unit(sample), np.random.default_rng(seed)
        centres, first, count = [sample.mean(axis=0)], [0], [0]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop(0)
            if len(rows) <= LEAF_ROWS:
                continue
            groups, found = _split(sample[rows], rng)
            if len(found) < 2:
                continue
            first[node], count[node] = len(centres), len(found)
            for g, centre in enumerate(found):
                todo.append((len(centres), rows[groups == g]))
                centres.append(centre)
                first.append(0)
                count.append(0)
        count_ = np.array(count)
        leaf = np.full(len(count), -1)
        leaf[count_ == 0] = np.arange((count_ == 0).sum())
        return Tree(np.array(centres), np.array(first), count_, leaf)

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: always the child with the nearest centre."""
        x = _unit(x)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[node] > 0)
            if len(inner) == 0:
                return self.leaf[node]
            for parent in np.unique(node[inner]):
                at = inner[node[inner] == parent]
                a, n = self.first[parent], self.count[parent]
                node[at] = a + _nearest(x[at], self.centres[a : a + n])

    def visits(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The first ``leaves`` leaves of each row's walk, best bin first."""
        leaves = min(leaves, self.leaves)
        none = np.zeros(self.leaves, np.int64), np.zeros(len(x), np.int64)
        return np.array(self.walks(x, leaves, *none), np.int32).reshape(len(x), leaves)

    def walks(self, x: np.ndarray, leaves: int, held: np.ndarray, least: np.ndarray) -> list[list[int]]:
        """The leaves of each row's walk: ``leaves`` and on until they hold the row's ``least`` rows, or all.

        ``held`` are the rows in each leaf.
        """
        x = _unit(x)
        leaves = min(leaves, self.leaves)
        # Squared distance but for the row's own length, which is 1 for all.
        far = (self.centres * self.centres).sum(axis=1) - 2 * (x @ self.centres.T)
        out = []
        for k in range(len(x)):
            own = far[k]
            queue, seen, rows = [(0.0, 0)], [], 0
            while queue and (len(seen) < leaves or rows < least[k]):
                _, node = heapq.heappop(queue)
                if self.count[node] == 0:
                    seen.append(int(self.leaf[node]))
                    rows += held[self.leaf[node]]
                    continue
                for child in range(self.first[node], self.first[node] + self.count[node]):
                    heapq.heappush(queue, (float(own[child]), child))
            out.append(seen)
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Groups of rows by k-means and their centres."""
    start = np.unique(x[rng.permutation(len(x))[: 8 * BRANCHES]], axis=0)
    centres = start[rng.permutation(len(start))[:BRANCHES]]
    for _ in range(ROUNDS):
        groups = _nearest(x, centres)
        sizes = np.bincount(groups, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, groups, x)
        centres = sums[sizes > 0] / sizes[sizes > 0][:, None]
    groups = _nearest(x, centres)
    used, groups = np.unique(groups, return_inverse=True)
    return groups, centres[used]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose largest component is one, and their lengths."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def _cosines(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray]):
    """Scores by one product, and a function that gives them again row by row, alike for equal vectors."""
    (q, q_size), (s, s_size) = queries, rows
    near = (q @ s.T) / (q_size[:, None] * s_size[None, :])
    return near, lambda r, c: (q[r] * s[c]).sum(axis=1) / (q_size[r] * s_size[c])


MARGIN = 1e-9


def _sample(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most the bounded number of rows, chosen by the hash of the id."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, 1.02 * most / n)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)
    got = picked.select("vec").toArrow().column("vec").combine_chunks()
    flat = got.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim) if len(flat) else np.zeros((0, dim))


def _scan(rows: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries among all indexed rows, with their leaves."""
    scaled = _scaled(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            for at, data in matrices(batch):
                few, data = enough_copies(ids[at], data, k)
                leaf_of = dict(zip(ids[at].tolist(), leaf[at].tolist(), strict=True))
                near, exact = _cosines(scaled, _scaled(data))
                row, vec_ids, score = best_of_tile(near, exact, np.full(len(queries), -(2**63)), few, k, MARGIN)
                leaves = [leaf_of[i] for i in vec_ids.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.astype(np.int64)), pa.array(vec_ids), pa.array(score), pa.array(leaves, pa.int32())],
                    ["uid", "vec_id", "score", "leaf"],
                )

    return rows.select("vec_id", "vec", "leaf").mapInArrow(run, "uid long, vec_id long, score double, leaf int")


class NeighbourIndex:
    """All rows of one dimension in the leaves of a tree, stored, and the number of leaves to visit."""

    def __init__(self, rows: DataFrame, dim: int, n: int, k: int, target: float = TARGET_RECALL):
        own = rows.filter(F.size("vec") == dim)
        sample = _sample(own, n, dim)
        self.tree, self.k, self.dim = Tree.fit(sample), k, dim
        tree = self.tree

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, data in matrices(batch):
                    leaves = pa.array(tree.leaf_of(data).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, leaves], ["vec_id", "vec", "leaf"])

        placed = own.select("vec_id", "vec").mapInArrow(place, "vec_id long, vec array<double>, leaf int")
        self.rows = store(placed, "neighbour-index")
        self.held = np.zeros(self.tree.leaves, np.int64)
        for leaf, count in self.rows.groupBy("leaf").count().collect():  # no more rows than leaves
            self.held[leaf] = count
        self.visited = self._calibrate(sample[:: max(1, len(sample) // CALIBRATION_QUERIES)][:CALIBRATION_QUERIES], target)

    def _calibrate(self, queries: np.ndarray, target: float) -> int:
        """Leaves to visit so that the share of true neighbours is found."""
        # One more neighbour, as a sampled row finds itself.
        found = merge_rows(_scan(self.rows, queries, self.k + 1), self.k + 1).toPandas()
        order = np.argsort(self.tree.visits(queries, self.tree.leaves), axis=1)
        needed = np.sort(order[found["uid"].to_numpy(), found["leaf"].to_numpy()]) + 1
        itself = len(queries)  # always in the first leaf
        needed = needed[min(itself, len(needed) - 1) :]
        return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])

    def parts(self, n_queries: int) -> tuple[int, int]:
        """Parts of the rows and groups of so many queries."""
        cells = int(self.held.sum()) * self.dim
        return grid(-(-8 * cells // TILE_BYTES), cells, n_queries * self.dim, n_queries * self.k)

    def search(self, queries: DataFrame, parts: int, groups: int) -> DataFrame:
        """Best rows found in each part for queries with ``uid``, ``vec_id``, ``vec`` and ``own``.

        ``own`` is the number of rows that may have the query's id.
        """
        tree, visited, held, k = self.tree, self.visited, self.held, self.k

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    _, _, data = unpack(row["ids"], row["uids"], row["data"], row["dim"])
                    wanted = np.zeros((len(data), tree.leaves), bool)
                    for at, leaves in enumerate(tree.walks(data, visited, held, k + np.frombuffer(row["own"], "<i8"))):
                        wanted[at, leaves] = True
                    row["wanted"] = np.packbits(wanted, axis=1).tobytes()
                    columns = {"tile": pa.int64(), "dim": pa.int32()} | dict.fromkeys(_ASKED, pa.binary())
                    yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], kind) for c, kind in columns.items()})

        schema = "tile long, dim int" + "".join(f", {c} binary" for c in _ASKED)
        blocks = pack(queries, bytes_of_tile=TILE_BYTES // 4, more=("own",)).mapInArrow(walk, schema)

        def look(q: dict, tile: dict, best: BestLists) -> None:
            byte, bit = divmod(tile["leaf"], 8)
            wanted = np.flatnonzero(q["wanted"][:, byte] & (128 >> bit))
            rows, step = _scaled(tile["data"]), max(1, HELD_CELLS // len(tile["ids"]))
            for a in range(0, len(wanted), step):
                asked = wanted[a : a + step]
                near, exact = _cosines(_scaled(q["data"][asked]), rows)
                at, ids, score = best_of_tile(
                    near, exact, q["ids"][asked], tile["ids"], k, MARGIN, best.least(asked)
                )
                best.add(asked[at], ids, score)

        rows = self.rows.withColumn("uid", F.lit(0).cast("long")).sortWithinPartitions("leaf")
        # One more copy of equal vectors, as the query's own row does not count.
        tiles = pack(rows, ("leaf",), copies=k)
        # Leaves lie one after the other over the parts, by their rows; the tiles of a leaf are dealt over its stretch.
        ends = np.cumsum(held) * (parts / max(1, held.sum()))
        first, width = (F.get(F.array(*map(F.lit, x.tolist())), "leaf") for x in (ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)))
        along = F.pmod(F.xxhash64("tile"), F.lit(1 << 20)) / (1 << 20)
        place = F.least(F.floor(first + width * along), F.lit(parts - 1))
        return best_in_parts(blocks, tiles, parts, groups, look, k, "double", kinds={"wanted": "u1"}, place=place)


def merge_rows(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of each query."""
    from pyspark.sql import Window

    by = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def nearest_found(queries: DataFrame, rows: DataFrame, k: int, target: float = TARGET_RECALL) -> DataFrame:
    """The ``k`` rows with the largest cosine that the tree search finds for each query.

    Both tables have ``vec_id`` and ``vec`` (array<double>, finite).  Zero
    vectors take no part; rows with the query's own id and of another dimension
    are no candidates; ties go to the smaller id; repeated rows and queries
    count one by one.  Columns: ``uid`` (of the query row), ``query_id``,
    ``rank``, ``vec_id``, ``score``.  Every query gets ``k`` rows, or all if there
    are fewer; empty tables give no rows.
    """
    some = F.exists("vec", lambda x: x != 0)
    rows = rows.filter(some)
    queries = queries.filter(some).select("vec_id", "vec", F.monotonically_increasing_id().alias("uid"))
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).filter("own > 1")
    queries = join_measured(queries, repeated, "vec_id", "left").withColumn("own", F.coalesce("own", F.lit(1)))
    queries = store(queries, "queries")
    found = queries.sparkSession.createDataFrame([], FOUND.format("double"))
    lists, asked = 1, dict(map(tuple, queries.groupBy(F.size("vec")).count().collect()))
    # A table of vectors has one dimension, or few.
    for dim, n in rows.groupBy(F.size("vec")).count().collect():
        index = NeighbourIndex(rows, dim, n, k, target)
        parts, groups = index.parts(asked.get(dim, 0))
        found = found.unionByName(index.search(queries.filter(F.size("vec") == dim), parts, groups))
        lists = max(lists, parts)
    return merge_best(found, k, lists)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    total, hit = (
        exact.join(found.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
        .agg(F.count(F.lit(1)), F.count("_hit"))
        .first()
    )
    return hit / total if total else 1.0
