"""Exact top-k search: products of query tiles and tiles of all rows, merged as a tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import store
from aftershock.llm.tiles import (
    HELD_CELLS,
    TILE_BYTES,
    BestLists,
    best_in_parts,
    best_of_tile,
    cells_of,
    grid,
    merge_best,
    pack,
)

# Queries of a tile take a quarter of a tile's bytes, so both sides are copied alike.
_QUERY_BYTES = TILE_BYTES // 4


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of long they stay at its ends."""
    bound = q.shape[1] * max(np.abs(q).max(initial=0), 1) * max(np.abs(s).max(initial=0), 1)
    for kind, most in ((np.float32, 2**24), (np.float64, 2**53)):
        if bound < most:
            return q.astype(kind) @ s.astype(kind).T  # every partial sum is a whole number that the type holds
    whole = [[[int(x) for x in row] for row in m] for m in (q, s)]
    big = np.array(whole[0], object) @ np.array(whole[1], object).T
    return np.clip(big, -(2**63), 2**63 - 1)


def top_products(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query.

    Both tables have ``vec_id`` and ``vec``, whole numbers as array<double>; rows
    with the query's own id and of another dimension are no candidates.  Ties go
    to the smaller id.  Repeated rows count one by one, and so do repeated
    queries.  Columns: ``uid`` (of the query row), ``query_id``, ``rank``,
    ``vec_id``, ``score``.  Empty tables give no rows.

    Queries and rows are cut into tiles; every tile of rows meets every query
    once, and only ``k`` rows a query leave a part of the rows.
    """
    queries = store(queries.select("vec_id", "vec", F.monotonically_increasing_id().alias("uid")), "queries")
    rows = rows.select("vec_id", "vec", F.lit(0).cast("long").alias("uid"))
    cells, asked = cells_of(rows), queries.agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("long"))).first()
    parts, groups = grid(-(-cells * 8 // TILE_BYTES), cells, asked[1] or 0, asked[0] * k)

    def look(q: dict, tile: dict, best: BestLists) -> None:
        step = max(1, HELD_CELLS // len(tile["ids"]))
        for a in range(0, len(q["ids"]), step):
            part = slice(a, a + step)
            near = _products(q["data"][part], tile["data"])
            at, ids, score = best_of_tile(
                near if near.dtype.kind == "f" else near.astype(np.float64), lambda r, c, near=near: near[r, c].astype(np.int64),
                q["ids"][part], tile["ids"], k, 0.0, best.least(part).astype(np.float64),
            )
            best.add(at + a, ids, score)

    blocks = pack(queries, bytes_of_tile=_QUERY_BYTES)
    found = best_in_parts(blocks, pack(rows, copies=k), parts, groups, look, k, "long")
    return merge_best(found, k, parts)
