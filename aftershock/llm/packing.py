"""Packing of documents into sequences of bounded length by column generation.

Each document gives as many full sequences as it can; what remains, its rest, is
shorter than a sequence.  The histogram of the rests is all the driver needs: a
linear program over patterns (sets of lengths that fill a sequence exactly) is
solved by column generation, where a knapsack table finds the pattern that the
current prices make most worthwhile.  Whole numbers of each pattern are then
dealt to the documents by their rank among those with a rest of equal length.
Rests that no pattern takes are laid one after the other and cut wherever a
sequence is full; the last cut-off is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.common import crc_of, store

# The program stops when this share of the tokens is in exact patterns, or after so many steps.
ENOUGH, STEPS = 0.995, 1500


def _cheapest_pattern(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[float, np.ndarray] | None:
    """Counts of lengths that sum up to exactly ``size`` at the least total price."""
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    choice = np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        k = upto[c]
        if k:
            cost = price[:k] + best[c - lengths[:k]]
            j = int(cost.argmin())
            best[c], choice[c] = cost[j], j
    if not np.isfinite(best[size]):
        return None
    counts = np.zeros(len(lengths))
    c = size
    while c:
        counts[choice[c]] += 1
        c -= lengths[choice[c]]
    return float(price @ counts), counts


def exact_patterns(supply: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns of lengths that fill a sequence exactly, and how often each is used.

    Maximises the number of such sequences as a linear program; the result is
    rounded down, then filled up greedily, and never uses more than the supply.
    """
    lengths = np.array(sorted(r for r, n in supply.items() if n > 0 and 0 < r < size), np.int64)
    if len(lengths) == 0:
        return []
    have = np.array([supply[int(r)] for r in lengths], float)
    m = len(lengths)
    inverse, x = np.eye(m), have.copy()
    columns: list[np.ndarray | None] = [None] * m  # None: what is left over of a length
    gain = np.zeros(m)
    bound = float(have @ lengths) / size

    def enter(counts: np.ndarray) -> bool:
        nonlocal x
        used = np.flatnonzero(counts)
        u = inverse[:, used] @ counts[used]
        up = np.flatnonzero(u > 1e-9)
        if len(up) == 0:
            return False
        ratio = np.maximum(x[up], 0) / u[up]
        out = up[ratio.argmin()]
        step = ratio.min()
        row = inverse[out] / u[out]
        moved = np.flatnonzero(np.abs(u) > 1e-12)
        inverse[moved] -= u[moved, None] * row[None, :]
        inverse[out] = row
        x[moved] -= u[moved] * step
        x[out] = step
        columns[out], gain[out] = counts, 1.0
        return True

    place = {int(r): i for i, r in enumerate(lengths)}
    for r, i in place.items():  # a good start: two rests that make a sequence
        j = place.get(size - r)
        if j is not None and i <= j:
            counts = np.zeros(m)
            counts[i] += 1
            counts[j] += 1
            enter(counts)
    for _ in range(STEPS):
        if gain @ x >= ENOUGH * bound:
            break
        price = np.maximum(gain @ inverse, 0)
        # A little per piece, so that of equal patterns the one with fewer pieces comes first.
        found = _cheapest_pattern(lengths, price + 1e-7, size)
        if found is None or price @ found[1] > 1 - 1e-5 or not enter(found[1]):
            break

    left = have.copy()
    patterns = []
    order = sorted((k for k in range(m) if columns[k] is not None), key=lambda k: -(x[k] % 1))
    times = {k: int(np.floor(max(x[k], 0) + 1e-6)) for k in order}
    for k in order:  # never beyond the supply, whatever rounding errors there are
        used = columns[k] > 0
        times[k] = int(min(times[k], np.floor(left[used] / columns[k][used]).min()))
        left -= times[k] * columns[k]
    for k in order:
        used = columns[k] > 0
        more = int(np.floor(left[used] / columns[k][used]).min())
        left -= more * columns[k]
        if times[k] + more:
            counts = {int(lengths[i]): int(columns[k][i]) for i in np.flatnonzero(used)}
            patterns.append((times[k] + more, counts))
    return patterns


@dataclass
class Layout:
    """Where the rests go, by length and rank; all of it is bounded by the sequence's size."""

    size: int
    first_free: int  # sequence after those of full pieces and patterns
    slots: dict[int, np.ndarray]  # per length rows of: first rank, times, first sequence, offset
    taken: dict[int, int]
    loose_at: dict[int, int]  # token position of the first rest that no pattern takes
    loose: int  # tokens of all of them

    @staticmethod
    def of(supply: dict[int, int], full: int, size: int) -> Layout:
        patterns = exact_patterns(supply, size)
        rows: dict[int, list] = {r: [] for r in supply}
        taken = dict.fromkeys(supply, 0)
        sequence = full
        for times, counts in patterns:
            offset = 0
            for r, n in sorted(counts.items(), reverse=True):
                for _ in range(n):
                    rows[r].append((taken[r], times, sequence, offset))
                    taken[r] += times
                    offset += r
            sequence += times
        loose_at, at = {}, 0
        for r in sorted(supply):
            loose_at[r] = at
            at += (supply[r] - taken[r]) * r
        slots = {r: np.array(v, np.int64).reshape(-1, 4) for r, v in rows.items()}
        return Layout(size, sequence, slots, taken, loose_at, at)

    def pieces_of_rest(self, r: int, rank: int) -> list[tuple[int, int, int]]:
        """Length, sequence and offset of each piece of a rest."""
        slots = self.slots[r]
        if rank < self.taken[r]:
            first, _, sequence, offset = slots[np.searchsorted(slots[:, 0], rank, "right") - 1]
            return [(r, int(sequence + rank - first), int(offset))]
        at = self.loose_at[r] + (rank - self.taken[r]) * r
        end, out = at + r, []
        whole = self.loose // self.size * self.size
        while at < end:
            if at < whole:
                k, begin, size = at // self.size, at // self.size * self.size, self.size
            else:  # powers of two, largest first
                begin, k, size = whole, self.loose // self.size, self.size
                while True:
                    size = 1 << ((self.loose - begin).bit_length() - 1)
                    if at < begin + size:
                        break
                    begin, k = begin + size, k + 1
            n = min(end, begin + size) - at
            out.append((n, self.first_free + k, at - begin))
            at += n
        return out


def place_documents(lengths: DataFrame, size: int) -> tuple[DataFrame, Layout]:
    """Ranks of the rests among equal ones, and the layout that turns ranks into sequences.

    ``lengths`` has a unique ``key`` and ``n_tokens``.  The table returned has
    ``key``, ``first_full`` (sequence of the document's first full piece) and
    ``rank``.  Ranks and running totals are made within hash parts, and the parts' totals are
    added up, so neither a frequent length nor the whole table meets in one task.
    """
    spark = lengths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest, full = F.col("n_tokens") % size, F.floor(F.col("n_tokens") / size)
    rows = lengths.select(
        "key", rest.cast("int").alias("rest"), full.cast("long").alias("full"),
        F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"),
    )
    by_part = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = Window.partitionBy("part", "rest").orderBy("key")
    local = store(
        rows.repartition(parts, "part")
        .withColumn("full_before", F.coalesce(F.sum("full").over(by_part), F.lit(0)))
        .withColumn("before", (F.row_number().over(by_rest) - 1).cast("long")),
        "rests",
    )
    cells = local.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
    cells = store(cells, "rest-counts")  # at most a row for each part and length
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("part").agg(F.sum("full").alias("part_full"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = totals.withColumn("full_ahead", F.coalesce(F.sum("part_full").over(ahead), F.lit(0)))
    offsets = cells.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(totals, "part")
    ranked = local.join(offsets.select("part", "rest", "ahead", "full_ahead"), ["part", "rest"]).select(
        "key",
        (F.col("full_ahead") + F.col("full_before")).alias("first_full"),
        (F.col("ahead") + F.col("before")).alias("rank"),
    )
    histogram = cells.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()
    supply = {r["rest"]: r["n"] for r in histogram if r["rest"]}
    return ranked, Layout.of(supply, sum(r["full"] for r in histogram), size)


def pack_documents(tokens: DataFrame, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens, which must be a power of two.

    ``tokens`` has ``key, doc_id, n_tokens, width, ids`` as from
    ``encode_documents``, each with a token at least, and should be stored, as it
    is read twice.  Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and, if wanted, ``ids``.  Every
    token lies in exactly one piece; pieces of a sequence leave no gap from 0 on;
    every sequence is full or its length a power of two, so nothing is padded.
    Repeated ids are separate documents; an empty table gives no rows.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    ranked, layout = place_documents(tokens.select("key", "n_tokens"), size)
    placed = tokens.join(ranked, "key")
    numbers = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "width", "first_full", "rank"))
            rows, ids_out = [], []
            for (doc_id, n, width, first, rank), raw in zip(zip(*columns, strict=True), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                pieces = [(size, first + i, 0) for i in range(n // size)]
                if n % size:
                    pieces += layout.pieces_of_rest(n % size, rank)
                start = 0
                for length, sequence, offset in pieces:
                    own = ids[start : start + length]
                    rows.append((doc_id, start, length, crc_of(own), n, sequence, offset))
                    if with_ids:
                        ids_out.append(own.astype(np.int32))
                    start += length
            arrays = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else []
            if arrays:
                more = [pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays + more, numbers + ["ids"] * with_ids)

    schema = ", ".join(f"{c} long" for c in numbers) + ", ids array<int>" * with_ids
    return placed.select("doc_id", "n_tokens", "width", "first_full", "rank", "ids").mapInArrow(cut, schema)
