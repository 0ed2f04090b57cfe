"""Vectors in tiles, tiles of queries and of rows that meet in tasks, and merging of best lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a tile's matrix, and products held at once.
TILE_BYTES = 1 << 21
HELD_CELLS = 1 << 19
# Lists merged at once.
FAN = 64
# Queries that a task holds, in bytes of their vectors and in places of their lists.
GROUP_BYTES, GROUP_PLACES = 1 << 25, 1 << 22
# Parts of the rows: so many if there are as many tiles, and more if they would be larger than so many bytes.
LEAST_PARTS, PART_BYTES = 24, 1 << 27
_OUT_ROWS = 1 << 16
TILE = "part int, tile long, dim int, ids binary, uids binary, data binary"
FOUND = "uid long, query_id long, tile long, vec_id long, score {}"


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns ``vec_id`` and ``vec`` (array of double); only rows that take part.

    Left out are rows without an id and vectors that are null, empty, or hold
    null or non-finite components.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vec_col}`").cast("array<double>").alias("vec"),
    )
    # NaN is the largest value; whether an array with a null contains a value it lacks is null.
    infinite = F.lit(float("inf"))
    finite = (F.array_max("vec") < infinite) & (F.array_min("vec") > -infinite) & ~F.array_contains("vec", infinite)
    return rows.filter("vec_id is not null and size(vec) > 0").filter(finite)


def matrices(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of the rows of each dimension."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def pack(
    rows: DataFrame,
    keys: tuple[str, ...] = (),
    bytes_of_tile: int = TILE_BYTES,
    copies: int | None = None,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``vec_id, uid, vec`` (and key columns) as rows of tiles, in the order they come.

    A tile holds vectors of one dimension and of one value of the keys, which
    must be ints and come sorted.  With ``copies``, equal vectors of a tile stay
    only as far as they can be among a query's best ``copies`` (their ``uid``
    is lost).  Without, columns of longs or of lists of longs, all of one length,
    can travel as ``more``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}

        def tile(key: tuple) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(key)
            ids, uids, data, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            made += 1
            if copies is not None:
                ids, data = enough_copies(ids, data, copies)
                uids = np.zeros(len(ids), np.int64)
            columns = {
                "part": pa.array([part], pa.int32()),
                "tile": pa.array([(part << 32) + made], pa.int64()),
                "dim": pa.array([key[-1]], pa.int32()),
                "ids": [ids.astype("<i8").tobytes()],
                "uids": [uids.astype("<i8").tobytes()],
                "data": [narrowed(data).tobytes()],
            }
            for name, values in zip(more, rest, strict=True):
                columns[name] = [values.astype("<i8").tobytes()]
            for name, value in zip(keys, key, strict=False):
                columns[name] = pa.array([value], pa.int32())
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            uids = batch.column("uid").to_numpy()
            named = [batch.column(k).to_numpy() for k in keys]
            rest = [_longs(batch.column(c)) for c in more]
            for at, data in matrices(batch):
                groups = np.zeros(len(at), np.int64)
                if keys:
                    change = np.any([k[at][1:] != k[at][:-1] for k in named], axis=0)
                    groups[1:] = np.cumsum(change)
                limit = max(1, bytes_of_tile // (8 * data.shape[1]))
                bounds = np.flatnonzero(np.diff(groups, prepend=-1, append=-1))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    key = (*(int(k[at[a]]) for k in named), data.shape[1])
                    for old in [x for x in held if keys and x[:-1] != key[:-1]]:
                        yield tile(old)
                    while a < b:
                        parts = held.setdefault(key, [])
                        have = sum(len(p[0]) for p in parts)
                        take = min(limit - have, b - a)
                        rows = at[a : a + take]
                        parts.append((ids[rows], uids[rows], data[a : a + take], *(x[rows] for x in rest)))
                        a += take
                        if have + take >= limit:
                            yield tile(key)
        for key in list(held):
            yield tile(key)

    schema = TILE + "".join(f", {k} int" for k in keys) + "".join(f", {c} binary" for c in more)
    return rows.select("vec_id", "uid", "vec", *keys, *more).mapInArrow(run, schema)


def _longs(column: pa.Array) -> np.ndarray:
    """Longs, or rows of lists of one length."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def narrowed(data: np.ndarray) -> np.ndarray:
    """The matrix in the first type of 2, 4 or 8 bytes that gives back every bit of its doubles."""
    data = np.ascontiguousarray(data, "<f8")
    with np.errstate(over="ignore", invalid="ignore"):
        for kind in ("<i2", "<f4"):
            small = data.astype(kind)
            if (small.astype("<f8").view("<i8") == data.view("<i8")).all():
                return small
    return data


def unpack(ids: bytes, uids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = 8 * len(data) // max(1, len(ids) * dim)
    flat = np.frombuffer(data, {2: "<i2", 4: "<f4"}.get(width, "<f8"))
    return np.frombuffer(ids, "<i8"), np.frombuffer(uids, "<i8"), flat.astype(np.float64).reshape(-1, dim)


def enough_copies(ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, the ones with the ``k + 1`` smallest ids; no other can be among a query's best ``k``.

    Rows of one id stay ``k`` times at most, and as many others beside them, as a query leaves out its own id.
    """
    order = np.lexsort((ids, *data.T[::-1]))
    ids, data = ids[order], data[order]
    new = np.ones(len(ids), bool)
    new[1:] = (data[1:] != data[:-1]).any(axis=1)
    keep = _rank(new | (np.diff(ids, prepend=ids[:1]) != 0)) < k
    group = (np.cumsum(new) - 1)[keep]
    ids, data = ids[keep], data[keep]
    new = np.diff(group, prepend=-1) != 0
    times = _rank(new | (np.diff(ids, prepend=ids[:1]) != 0)) + 1
    most = np.maximum.reduceat(times, np.flatnonzero(new)) if len(ids) else times
    keep = _rank(new) < k + most[group]
    return ids[keep], data[keep]


def _rank(new: np.ndarray) -> np.ndarray:
    """Number of each row in its group; ``new`` marks the groups' first rows."""
    return np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]


def best_of_tile(
    near: np.ndarray,
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray],
    query_ids: np.ndarray,
    ids: np.ndarray,
    k: int,
    margin: float,
    least: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` candidates of each query in a tile: query rows, ids, scores.

    ``near`` holds scores that may be off by half the margin, and is overwritten;
    rows with the query's own id are left out; equal scores go to the smaller id.
    Scores below a query's ``least`` are not wanted and may be left out.
    """
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids, query_ids, side, sorter=by_id) for side in ("left", "right"))
    for q in np.flatnonzero(last > first):
        near[q, by_id[first[q] : last[q]]] = -np.inf
    n = near.shape[1]
    least = (np.full(len(near), -np.inf) if least is None else least - margin).astype(near.dtype)
    found = near >= least[:, None]
    many = np.flatnonzero(np.count_nonzero(found, axis=1) > 4 * k) if n > k else []
    if len(many):
        kth = np.partition(near[many], n - k, axis=1)[:, n - k] - margin
        found[many] &= near[many] >= kth[:, None]
    rows, cols = np.nonzero(found)
    some = near[rows, cols] > -np.inf
    rows, cols = rows[some], cols[some]
    score = np.concatenate(
        [exact(rows[a : a + 100_000], cols[a : a + 100_000]) for a in range(0, len(rows), 100_000)]
        or [exact(rows, cols)]
    )
    order = np.lexsort((ids[cols], _falling(score), rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[cols[keep]], score[keep]


def _falling(score: np.ndarray) -> np.ndarray:
    """Keys that sort the largest score first; the smallest long has no negative."""
    return ~score if score.dtype.kind == "i" else -score


class BestLists:
    """The best ``k`` rows so far in each of ``n`` lists; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int, kind: type):
        self.k = k
        self.ids, self.score = np.zeros((n, k), np.int64), np.zeros((n, k), kind)
        self.count = np.zeros(n, np.int64)

    def least(self, lists) -> np.ndarray:
        """Score of the last row of each full list, the smallest value for the others."""
        kind = self.score.dtype
        none = -np.inf if kind.kind == "f" else np.iinfo(kind).min
        return np.where(self.count[lists] == self.k, self.score[lists, -1], none)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows for the lists ``at``, in any order."""
        lists, at = np.unique(at, return_inverse=True)
        have = np.arange(self.k) < self.count[lists, None]
        at = np.concatenate([np.nonzero(have)[0], at])
        ids = np.concatenate([self.ids[lists][have], ids])
        score = np.concatenate([self.score[lists][have], score])
        order = np.lexsort((ids, _falling(score), at))
        at, ids, score = at[order], ids[order], score[order]
        place = _rank(np.diff(at, prepend=-1) != 0)
        keep = place < self.k
        at, place = at[keep], place[keep]
        self.ids[lists[at], place], self.score[lists[at], place] = ids[keep], score[keep]
        self.count[lists] = np.bincount(at, minlength=len(lists))


def cells_of(rows: DataFrame) -> int:
    """Components of all vectors."""
    return rows.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0


def grid(row_tiles: int, row_cells: int, query_cells: int, query_places: int = 0) -> tuple[int, int]:
    """Parts of the rows and groups of the queries; a task has one of each.

    Rows travel once for each group and queries once for each part, so a group
    is what a task can hold, and there are no more parts than keep tasks short.
    """
    groups = max(1, -(-8 * query_cells // GROUP_BYTES), -(-query_places // GROUP_PLACES))
    return min(max(1, row_tiles), max(LEAST_PARTS, -(-8 * row_cells // PART_BYTES))), groups


def _place(tile: Column, n: int) -> Column:
    """One of ``n`` places: tiles that a task has made go to places one after the other."""
    task, number = F.shiftright(tile, 32), tile.bitwiseAND(F.lit((1 << 32) - 1))
    return F.pmod(F.pmod(F.xxhash64(task), F.lit(n)) + number, F.lit(n))


def best_in_parts(
    blocks: DataFrame,
    tiles: DataFrame,
    parts: int,
    groups: int,
    look: Callable[[dict, dict, BestLists], None],
    k: int,
    score: str,
    slots: int = 1,
    kinds: dict[str, str] | None = None,
    place: Column | None = None,
) -> DataFrame:
    """Best lists of all queries in every part of the rows, as in ``FOUND``; ``tile`` is the part.

    ``blocks`` of queries and ``tiles`` of rows are as ``pack`` makes them, with
    further binary columns of longs, or of what ``kinds`` says.  Every block meets every tile of its dimension once: a task holds a
    group of queries, reads the tiles of a part one after the other and keeps the
    best rows so far, so no others leave it.  ``look`` gets the queries, a tile
    and the lists to add to, ``slots`` lists a query; the result's ``uid`` is
    ``uid * slots + slot``.  Both sides are shuffled: the copies of the queries
    grow with the rows too, and Spark, which does not know their size, would
    else send them all through the driver.  ``place`` is a tile's part, if it
    matters; tiles of one leaf that come one after the other are read as one.
    """
    blocks = blocks.withColumns({"_rows": F.lit(False), "_copy": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    blocks = blocks.withColumn("_cell", _place(F.col("tile"), groups) * parts + F.col("_copy"))
    tiles = tiles.withColumns({"_rows": F.lit(True), "_copy": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    part = _place(F.col("tile"), parts) if place is None else place
    tiles = tiles.withColumn("_cell", F.col("_copy") * parts + part)
    both = blocks.unionByName(tiles, allowMissingColumns=True).drop("_copy", "tile", "part")
    order = ["_cell", "_rows", "dim", *(["leaf"] if "leaf" in both.columns else [])]
    both = both.repartitionById(parts * groups, F.col("_cell").cast("int")).sortWithinPartitions(*order)
    kind = np.int64 if score == "long" else np.float64

    def joined(rows: list[dict]) -> dict:
        """Rows of one dimension as one."""
        names = [c for c, x in rows[0].items() if isinstance(x, np.ndarray)]
        return rows[0] | {c: np.concatenate([r[c] for r in rows]) for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, held = None, {}, []  # asked: by dimension, blocks or the queries and their lists

        def met() -> None:
            """The tiles held meet the queries of their dimension."""
            if held and (q := asked.get(held[0]["dim"])):
                if isinstance(q, list):
                    whole = joined(q)
                    q = asked[whole["dim"]] = (whole, BestLists(len(whole["ids"]) * slots, k, kind))
                look(q[0], joined(held), q[1])
            held.clear()

        def ended() -> Iterator[pa.RecordBatch]:
            met()
            for q in asked.values():
                if isinstance(q, list):
                    continue
                q, lists = q
                step = max(1, _OUT_ROWS // k)
                for a in range(0, len(lists.count), step):
                    at, place = np.nonzero(np.arange(k) < lists.count[a : a + step, None])
                    at = at + a
                    columns = {
                        "uid": q["uids"][at // slots] * slots + at % slots, "query_id": q["ids"][at // slots],
                        "tile": np.full(len(at), cell % parts), "vec_id": lists.ids[at, place],
                        "score": lists.score[at, place],
                    }
                    yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})
            asked.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: x for c in batch.schema.names if (x := batch.column(c)[i].as_py()) is not None}
                if cell != row["_cell"]:
                    yield from ended()
                    cell = row["_cell"]
                row["ids"], row["uids"], row["data"] = unpack(row["ids"], row["uids"], row["data"], row["dim"])
                for c, x in row.items():
                    if isinstance(x, bytes):
                        row[c] = np.frombuffer(x, (kinds or {}).get(c, "<i8")).reshape(len(row["ids"]), -1)
                if not row["_rows"]:
                    asked.setdefault(row["dim"], []).append(row)
                    continue
                alike = held and all(held[0].get(c) == row.get(c) for c in ("dim", "leaf"))
                if not alike or sum(r["data"].nbytes for r in held) + row["data"].nbytes > TILE_BYTES:
                    met()
                held.append(row)
        yield from ended()

    return both.mapInArrow(run, FOUND.format(score))


def merge_best(found: DataFrame, k: int, lists: int) -> DataFrame:
    """Merges the tiles' best lists of each query as a tree; ``lists`` is about their number.

    ``tile`` numbers lie anywhere; each level merges about ``FAN`` lists of a query.
    """
    best = [F.col("score").desc(), F.col("vec_id")]
    groups = -(-lists // FAN)
    while groups > 1:
        by = Window.partitionBy("uid", "_group").orderBy(*best)
        found = (
            found.withColumn("_group", F.pmod(F.xxhash64("tile"), F.lit(groups)))
            .withColumn("_rank", F.row_number().over(by))
            .filter(F.col("_rank") <= k)
            .withColumn("tile", F.col("_group"))
            .drop("_rank", "_group")
        )
        groups = groups // FAN
    by = Window.partitionBy("uid").orderBy(*best)
    return (
        found.withColumn("rank", F.row_number().over(by))
        .filter(F.col("rank") <= k)
        .select("uid", "query_id", "rank", "vec_id", "score")
    )
