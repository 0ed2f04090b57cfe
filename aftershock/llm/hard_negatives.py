"""Hard negatives: rows of another label whose score lies in a window below a positive's.

Vectors are rotated and kept as one bit a component, together with the alignment
of the vector with its code and the length of what the code leaves out.  A popcount
per bit plane of the quantised anchor gives its product with a code; the
Cauchy-Schwarz inequality on the rests turns that into an interval that surely
holds the true score.  Intervals that cannot matter are dropped, the scores of the
others are computed as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import kept_in_worker, store
from aftershock.llm.tiles import TILE_BYTES, BestLists, best_in_parts, cells_of, grid, merge_best, pack, unpack
from aftershock.llm.top_products import _products

# Bits of a component of an anchor.
PLANES = 8
# Anchor and row pairs that a task looks at at once.
_CELLS, _FIRST_ROWS = 1 << 19, 256
# ``uids`` are the labels.
_CODED = "tile long, dim int, ids binary, uids binary, data binary, bits binary, align binary, rest binary"
_KINDS = {"bits": "<u8", "align": "<f8", "rest": "<f8"}


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""

    def make() -> np.ndarray:
        return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]

    return kept_in_worker(("rotation", dim), make)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    padded = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


def code(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of vectors, each vector's product with its unit code vector, and the length of the rest."""
    turned = data @ rotation(data.shape[1])
    align = np.abs(turned).sum(axis=1) / np.sqrt(data.shape[1])
    rest = np.sqrt(np.maximum((data * data).sum(axis=1) - align * align, 0))
    return _words(turned > 0), align, rest


def intervals(
    queries: np.ndarray, bits: np.ndarray, align: np.ndarray, rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of all queries with all coded vectors."""
    dim = queries.shape[1]
    turned = queries @ rotation(dim)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.int64)
    rounded = low + step * level
    off = np.sqrt(((turned - rounded) ** 2).sum(axis=1))
    shape, most = (len(queries), len(bits)), dim * ((1 << PLANES) - 1)
    summed = np.zeros(shape, np.uint16 if most < 1 << 16 else np.uint32)
    both, ones = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    for w in range(bits.shape[1]):
        word, part = np.ascontiguousarray(bits[:, w]), np.zeros_like(summed)
        for plane in reversed(range(PLANES)):
            np.bitwise_and(_words((level >> plane) & 1 == 1)[:, w, None], word, out=both)
            np.bitwise_count(both, out=ones)
            part += part
            part += ones
        summed += part
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    # Product of the rounded query with the code vector, whose components are one over root dim, with signs.
    along = summed * (2 * step / np.sqrt(dim))
    along += (2 * low / np.sqrt(dim)) * ones
    along -= rounded.sum(axis=1, keepdims=True) / np.sqrt(dim)
    square = (queries * queries).sum(axis=1, keepdims=True)
    half = np.abs(along)
    half -= off[:, None]
    np.maximum(half, 0, out=half)
    half *= half
    np.subtract(square, half, out=half)
    np.maximum(half, 0, out=half)
    np.sqrt(half, out=half)
    # What rounding of these steps takes: 1e-9 * (1 + sqrt(square) * (align + rest)).
    slack = 1e-9 * np.sqrt(square)
    half += slack
    half *= rest
    half += (off[:, None] + slack) * align
    half += 1e-9
    along *= align
    lower = along - half
    along += half
    return lower, along


def _best(
    near: np.ndarray, product: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores from ``least`` to ``most`` of each row, cut to its best ``k`` if there are far more.

    Rows that have ``near`` at minus infinity there do not count; it may be rounded, unlike ``product``.
    """
    lowest = np.maximum(least, np.iinfo(np.int64).min).astype(near.dtype)
    may = (near >= lowest[:, None]) & (near <= most.astype(near.dtype)[:, None])
    many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * k)
    if len(many):
        n = near.shape[1]
        kth = np.partition(np.where(may[many], near[many], -np.inf), n - k, axis=1)[:, n - k]
        may[many] &= near[many] >= kth[:, None]
    rows, cols = np.nonzero(may)
    score = product[rows, cols].astype(np.int64)
    keep = (score >= least[rows]) & (score <= most[rows])
    return rows[keep], cols[keep], score[keep]


def _near(product: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Products in floats, with minus infinity for those that do not count."""
    near = np.array(product, product.dtype if product.dtype.kind == "f" else np.float64)
    near[~own] = -np.inf
    return near


def positives_of(q: dict, tile: dict, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Best rows of a tile with the anchor's label: anchor rows, slots, columns, scores.

    A row is scored if its score may reach the ``floor`` of an anchor, the last of its ``k`` best so far.
    """
    long = np.iinfo(np.int64)
    for label in np.intersect1d(q["label"], tile["labels"]):
        at, cols = np.flatnonzero(q["label"] == label), np.flatnonzero(tile["labels"] == label)
        step = max(1, _CELLS // len(cols))
        for a in range(0, len(at), step):
            asked = at[a : a + step]
            floor, queries = q["floor"][asked, 0], q["vec"][asked]
            _, upper = intervals(queries, *(tile[c][cols] for c in ("bits", "align", "rest")))
            wanted = cols[(upper >= _bound(floor)[:, None]).any(axis=0)]
            product = _products(queries, tile["data"][wanted])
            near = _near(product, q["vec_id"][asked, None] != tile["ids"][wanted])
            rows, found, score = _best(near, product, tile["ids"][wanted], floor, np.full(len(asked), long.max), k)
            yield asked[rows], np.zeros(len(rows), np.int64), wanted[found], score


def negatives_of(q: dict, tile: dict, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Best rows of a tile with another label in each of the anchor's windows, as above."""
    step = max(1, _CELLS // len(tile["ids"]))
    for a in range(0, len(q["vec"]), step):
        part = slice(a, a + step)
        least, most = np.maximum(q["least"][part], q["floor"][part]), q["most"][part]
        empty = least > most
        # From the lowest to the highest score that any of the anchor's windows takes.
        low = np.where(empty, np.inf, _bound(least)).min(axis=1, keepdims=True)
        high = np.where(empty, -np.inf, most).max(axis=1, keepdims=True)
        lower, upper = intervals(q["vec"][part], tile["bits"], tile["align"], tile["rest"])
        wanted = np.flatnonzero(((upper >= low) & (lower <= high)).any(axis=0))
        product = _products(q["vec"][part], tile["data"][wanted])
        other = q["label"][part, None] != tile["labels"][wanted]
        other &= q["vec_id"][part, None] != tile["ids"][wanted]
        near = _near(product, other)
        rows, found = np.nonzero((near >= low.astype(near.dtype)) & (near <= high.astype(near.dtype)) & other)
        if len(rows) <= 8 * k * len(near):
            score = product[rows, found].astype(np.int64)
            at, slot = np.nonzero((score[:, None] >= least[rows]) & (score[:, None] <= most[rows]))
            yield a + rows[at], slot, wanted[found[at]], score[at]
            continue
        for slot in range(least.shape[1]):
            rows, found, score = _best(near, product, tile["ids"][wanted], least[:, slot], most[:, slot], k)
            yield a + rows, np.full(len(rows), slot), wanted[found], score


def _bound(score: np.ndarray) -> np.ndarray:
    """Scores in doubles; the smallest long stands for any score."""
    return np.where(score == np.iinfo(np.int64).min, -np.inf, score)


def _coded(rows: DataFrame) -> DataFrame:
    """Tiles of rows with their codes; stored."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, data = unpack(row["ids"], row["uids"], row["data"], row["dim"])
                coded = zip(_KINDS, code(data), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"tile": pa.array([row["tile"]], pa.int64()), "dim": pa.array([row["dim"]], pa.int32())}
                    | {c: [row[c]] for c in ("ids", "uids", "data")}
                    | {c: [np.ascontiguousarray(x).tobytes()] for c, x in coded}
                )

    tiles = pack(rows.select("vec_id", F.col("label").alias("uid"), "vec"))
    return store(tiles.select("tile", "dim", "ids", "uids", "data").mapInArrow(add, _CODED), "codes")


def _search(
    tiles: DataFrame, parts: int, groups: int, anchors: DataFrame, slots: int, find, k: int, windows: tuple[str, ...] = ()
) -> DataFrame:
    """Best lists of ``anchors`` (``uid, vec_id, label, vec`` and ``windows``) over all tiles.

    Every anchor meets every tile once.  The result's ``uid`` is ``uid * slots + slot``.
    """
    blocks = pack(anchors, bytes_of_tile=TILE_BYTES // 4, more=("label", *windows))

    def look(q: dict, rows: dict, best: BestLists) -> None:
        tile = {"ids": rows["ids"], "labels": rows["uids"], "data": rows["data"], "bits": rows["bits"]}
        tile |= {c: rows[c][:, 0] for c in ("align", "rest")}
        asked = {"vec_id": q["ids"], "label": q["label"][:, 0], "vec": q["data"]} | {c: q[c] for c in windows}
        # While lists are not full, few rows at a time, as full ones spare most of the others.
        a, n = 0, len(tile["ids"]) if (best.count == k).all() else _FIRST_ROWS
        while a < len(tile["ids"]):
            part = {c: x[a : a + n] for c, x in tile.items()}
            floor = best.least(slice(0, len(q["ids"]) * slots)).reshape(-1, slots)
            for at, slot, cols, score in find(asked | {"floor": floor}, part, k):
                best.add(at * slots + slot, part["ids"][cols], score)
            a, n = a + n, 2 * n

    return merge_best(best_in_parts(blocks, tiles, parts, groups, look, k, "long", slots, _KINDS), k, parts)


def hard_negatives(
    anchors: DataFrame,
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    Both tables have ``vec_id``, ``label`` (long) and ``vec``, whole numbers as
    array<double>, without nulls.  Scores are inner products.  An anchor's
    positives are its best ``positives`` rows of the same label and another id;
    a positive's negatives its best ``negatives`` rows of another label whose
    score is from ``low_percent`` to ``high_percent`` percent of the positive's.
    Equal scores go to the smaller id; fewer rows than asked for are all
    returned.  A positive with a negative score has none.  Repeated rows and
    anchors count one by one; rows of the anchor's id or of another dimension do
    not count; empty tables give no rows; other columns are not read.

    Columns: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.
    """
    columns = ["vec_id", "label", "vec"]
    asked = store(anchors.select(F.monotonically_increasing_id().alias("uid"), *columns), "anchors")
    rows = rows.select(columns)
    cells, own = cells_of(rows), asked.agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("long"))).first()
    row_tiles = -(-cells * 8 // TILE_BYTES)
    tiles = _coded(rows)

    size = grid(row_tiles, cells, own[1] or 0, own[0] * positives)
    found = _search(tiles, *size, asked, 1, positives_of, positives)
    found = store(found.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), "positives")

    # Bounds of each anchor's windows by the positive's rank; without a positive an empty window.
    def bound(column: str, empty: int):
        at = [F.max(F.when(F.col("rank") == i + 1, F.expr(column))) for i in range(positives)]
        return F.array(*[F.coalesce(x, F.lit(empty)).cast("long") for x in at])

    windows = found.groupBy("uid").agg(
        # Division of longs towards minus infinity.
        bound(f"-floor(-(cast({low_percent} as decimal(38,0)) * positive_score) / 100)", 1).alias("least"),
        bound(f"floor((cast({high_percent} as decimal(38,0)) * positive_score) / 100)", 0).alias("most"),
    )
    second = store(asked.join(windows, "uid"), "anchors")
    size = grid(row_tiles, cells, own[1] or 0, own[0] * positives * negatives)
    negative = _search(tiles, *size, second, positives, negatives_of, negatives, ("least", "most")).select(
        F.expr(f"uid div {positives}").alias("uid"), F.expr(f"uid % {positives}").alias("_slot"),
        F.col("rank").alias("_rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    found = found.withColumn("_slot", (F.col("rank") - 1).cast("long"))
    return found.join(negative, ["uid", "_slot"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("_rank").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
