"""Near-duplicate documents with a forest of sorted MinHash signatures.

Every distinct shingle set is a node with a signature of minima.  Under each of
several orders of the signature's positions the nodes form a sorted list; a
region is a run of nodes that share a prefix.  Candidates come from regions:

* nodes of a small region are compared with each other, nodes of a larger one
  with the region's smallest node;
* then larger regions whose nodes are not yet in one component are compared as
  products of blocks of their shingle sets;
* regions too large for that are looked at with a longer prefix and, as a longer
  prefix finds less, in more orders.  Each order has positions of its own, so
  longer signatures of these nodes are made from their sets.  At the longest
  prefix regions of any size are compared in blocks.

Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import documents_of, join_measured, mixed, slices, store, text_bytes
from aftershock.llm.components import components
from aftershock.llm.words import shingle_sets

SIGNATURE = 96
# Prefix lengths and the number of orders for each: two sets with a similarity of
# 0.8 meet in no order of a level with a probability of 0.3, 0.8 and 0.9 in 100,000,
# as no two orders have a position in common.
LEVELS = ((4, 24), (8, 64), (12, 164))
# Regions up to this size are compared pair by pair, and up to that size in blocks
# before a longer prefix is tried.
SMALL, LARGE, BLOCK = 32, 2048, 256
# Bits of a sketch (one per position) that may differ; at a similarity of 0.8 a
# tenth does, and more than this with a probability of 5 in 10,000,000.
SKETCH_DIFFERS = 26
_SEEDS = mixed(np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SETS = "row long, doc_id long, th long, n_shingles long, set_key binary, signature binary, s1 long, s2 long"


def _orders(level: int) -> np.ndarray:
    """Positions that make up the prefix in each order of a level; no position is used twice."""
    depth, count = LEVELS[level]
    first = sum(d * c for d, c in LEVELS[:level])
    return first + np.arange(depth * count).reshape(count, depth)


def _minima(key: np.ndarray, starts: np.ndarray, position: int) -> np.ndarray:
    """A position of the signatures of sets that begin at ``starts``."""
    a, b = mixed(np.array([2 * position + 1, 2 * position + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # A multiplication by an odd number is a permutation; its top bits are well mixed.
    return np.minimum.reduceat(key * (a | np.uint64(1)) + b, starts) >> np.uint64(32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def _set_keys(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes | None]]:
    """Set sizes and 128-bit keys of sets; none for empty sets."""
    sizes = np.bincount(owner, minlength=n)
    has = np.flatnonzero(sizes)
    starts = np.searchsorted(owner, has)
    parts = np.stack([_sums(mixed(key ^ _SEEDS[i]), starts) for i in (0, 1)], axis=1).astype("<u8")
    keys: list[bytes | None] = [None] * n
    for i, k in zip(has.tolist(), parts, strict=True):
        keys[i] = k.tobytes()
    return sizes, keys


def shingle_signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, key of the set, signature and its sketch.

    ``row`` is unique, ``th`` a hash of the text.  Documents without words have size 0 and nulls.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in slices(batches, "text"):
            n = batch.num_rows
            owner, key = shingle_sets(*text_bytes(batch.column("text")), words)
            sizes, keys = _set_keys(owner, key, n)
            has = np.flatnonzero(sizes)
            starts = np.searchsorted(owner, has)
            signature = np.empty((len(has), SIGNATURE), "<u4")
            for k in range(SIGNATURE if len(has) else 0):
                signature[:, k] = _minima(key, starts, k)
            odd = (mixed(signature.astype(np.uint64)) >> np.uint64(63)).astype(bool)
            sketch = np.zeros((2, n), np.int64)
            for half, part in enumerate((odd[:, :64], odd[:, 64:])):
                sketch[half, has] = (part * bit[: part.shape[1]]).sum(axis=1, dtype=np.uint64).view(np.int64)
            raw: list[bytes | None] = [None] * n
            for i, s in zip(has.tolist(), signature, strict=True):
                raw[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("th"), pa.array(sizes),
                    pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array(sketch[0]), pa.array(sketch[1]),
                ],
                ["row", "doc_id", "th", "n_shingles", "set_key", "signature", "s1", "s2"],
            )
            row += n

    plain = documents_of(docs, id_col, text_col)
    return plain.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(sign, _SETS)


def _regions(n: int, orders: np.ndarray, position) -> np.ndarray:
    """Hash of each set's prefix in each order; ``position`` gives that position of all signatures."""
    out = np.empty((n, len(orders)), np.uint64)
    for t, order in enumerate(orders):
        h = np.full(n, t + 1, np.uint64)
        for p in order:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + position(int(p)))
        out[:, t] = h
    return out


def _hits(nodes: DataFrame, level: int) -> DataFrame:
    """``region, node, s1, s2``: a row for each node and order whose prefix another node shares.

    The first level reads ``signature``, others read the sets, ``items``.
    """
    orders = _orders(level)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if level == 0 else slices(batches, "items"):
            n = batch.num_rows
            if level == 0:
                raw = b"".join(batch.column("signature").to_pylist())
                signature = np.frombuffer(raw, "<u4").reshape(-1, SIGNATURE).astype(np.uint64)
                out = _regions(n, orders, lambda p: signature[:, p])
            else:
                raw, offsets = text_bytes(batch.column("items"))
                key, starts = raw.view("<u8") if len(raw) else np.zeros(0, np.uint64), offsets[:-1] // 8
                out = _regions(n, orders, lambda p: _minima(key, starts, p))
            offsets = np.arange(n + 1, dtype=np.int32) * len(orders)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "s1", "s2")] + [lists], ["node", "s1", "s2", "regions"]
            )

    hits = nodes.select("node", "s1", "s2", "signature" if level == 0 else "items").mapInArrow(
        keys, "node long, s1 long, s2 long, regions array<long>"
    )
    hits = hits.select("node", "s1", "s2", F.explode("regions").alias("region"))
    stars = hits.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot"))
    return store(hits.join(stars.filter("size > 1"), "region"), "region-hits")


def _alike(x: str, y: str) -> str:
    """Whether two sketches may belong to similar sets."""
    return f"bit_count({x}.s1 ^ {y}.s1) + bit_count({x}.s2 ^ {y}.s2) <= {SKETCH_DIFFERS}"


@dataclass
class _Sets:
    """Shingle sets of wanted nodes, made again from their texts."""

    docs: DataFrame
    nodes: DataFrame  # node, doc_id, th, set_key
    words: int

    def of(self, wanted: DataFrame) -> DataFrame:
        """``node, n, items`` (sorted 64-bit hashes as binary) for the given distinct nodes; stored."""
        words = self.words
        asked = self.nodes.join(wanted, "node")
        asked = asked.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "set_key", "node")
        # Rows of one id, or without one, meet only their own text's node.
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
        rows = join_measured(self.docs, asked, same)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                n = batch.num_rows
                owner, key = shingle_sets(*text_bytes(batch.column("text")), words)
                sizes, keys = _set_keys(owner, key, n)
                ends = np.cumsum(sizes)
                # Texts of one hash may differ; only the node's own set counts.
                own = [k is not None and k == w for k, w in zip(keys, batch.column("set_key").to_pylist(), strict=True)]
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(pa.array(at)), pa.array(sizes[at]),
                        pa.array([key[ends[i] - sizes[i] : ends[i]].astype("<u8").tobytes() for i in at], pa.binary()),
                    ],
                    ["node", "n", "items"],
                )

        made = rows.select("text", "set_key", "node").mapInArrow(make, "node long, n long, items binary")
        return store(made.dropDuplicates(["node"]), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that are links on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                found = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[found] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            picked = batch.filter(pa.array(keep, pa.bool_()))
            yield picked.select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _block_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that connect nodes of different components within cells of two blocks."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        sizes = table.column("n").to_numpy()
        items = np.frombuffer(b"".join(table.column("items").to_pylist()), "<u8")
        owner = np.repeat(np.arange(len(node)), sizes)
        _, item, times = np.unique(items, return_inverse=True, return_counts=True)
        several = times[item] > 1
        number = np.cumsum(times > 1) - 1
        item, owner = number[item[several]], owner[several]
        order = np.argsort(item, kind="stable")
        item, owner = item[order], owner[order]
        both = np.zeros((len(node), len(node)), np.float32)
        for first in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
            a, b = np.searchsorted(item, [first, first + 4096])
            has = np.zeros((len(node), 4096), np.float32)
            has[owner[a:b], item[a:b] - first] = 1
            both += has @ has.T  # counts below 2 ** 24 are exact
        both = both.astype(np.int64)
        link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(np.triu(link & (comp[:, None] != comp[None, :]), 1))
        # One link for each two components joined is enough.
        pairs = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            pairs.setdefault((min(comp[x], comp[y]), max(comp[x], comp[y])), (node[x], node[y]))
        found = list(pairs.values())
        return pa.table(
            {"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())}
        )

    return cells.groupBy("region", "i", "j").applyInArrow(compare, "a long, b long")


def _with_comp(df: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds the component so far; a node without links is its own."""
    return df.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Two documents are linked if their sets of ``words``-word shingles (A-Z in
    lower case, words parted by white space) share at least ``percent`` percent
    of their union.  ``component_id`` is the smallest id that can be reached over
    links, the own one included; ``kept`` marks documents whose id it is.  A text
    with fewer words is one shingle; null and empty texts have none, are linked
    with nothing and kept.  Repeated ids are separate documents; one without an id has the
    smallest id of its component, or null, and is not kept.  Equal sets are one node from the
    start, so copies cost nothing.  An empty table gives no rows.
    """
    rows, classes, comps = _grouped(documents_of(docs, id_col, text_col), words, percent)
    named = _with_comp(classes, comps)
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "comp").select("set_key", "component_id")
    # Rows without a shingle find no class; they would share one null key.
    full = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(named, "set_key")
    bare = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(bare)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _grouped(plain: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their signatures, classes of equal sets, and the components of the classes' nodes."""
    rows = store(shingle_signatures(plain, words), "signatures")
    classes = store(
        rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")),
        "classes",
    )
    reps = rows.join(classes.select(F.col("node").alias("row")), "row", "leftsemi")
    reps = store(reps.withColumnRenamed("row", "node"), "nodes")
    sets = _Sets(plain, reps.select("node", "doc_id", "th", "set_key"), words)
    return rows, classes, _components(reps, sets, percent)


def one_of_each_component(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of linked rows exactly one stays.

    It is the one with the smallest id, rows without an id last; of rows of that id
    one by a hash of the text, and of equal rows any.  Texts without a shingle all stay.
    """
    rows, classes, comps = _grouped(documents_of(docs, id_col, text_col), words, percent)
    named = _with_comp(classes, comps).select("set_key", "comp")
    full = rows.filter("n_shingles > 0").join(named, "set_key")
    texts = store(full.groupBy("comp", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "texts")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = texts.groupBy("comp").agg(F.min(place).alias("first"))
    # All rows of a text go, or all but one; a text that stays and comes once needs no row here.
    marked = texts.join(first, "comp").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n", (place == F.col("first")).alias("_stays")
    )
    marked = store(marked.filter("NOT _stays OR n > 1").drop("n"), "marked")
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = id_.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th"))
    out = join_measured(docs, marked.select("_id", "_th"), same, "leftanti")
    repeated = marked.filter("_stays")
    if repeated.isEmpty():
        return out
    once = join_measured(docs, repeated.select("_id", "_th"), same).dropDuplicates(["_id", "_th"])
    return out.unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _components(nodes: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """``node, comp`` of all nodes with a confirmed link, over links that connect all similar nodes."""
    comps, active = None, nodes
    for level in range(len(LEVELS)):
        hits = _hits(active, level)
        # Small regions pair by pair; of others every node against the region's smallest one.
        x, y = hits.alias("x"), hits.alias("y")
        both = F.expr(f"x.node < y.node AND (x.size <= {SMALL} OR x.node = x.pivot) AND {_alike('x', 'y')}")
        pairs = x.join(y, (F.col("x.region") == F.col("y.region")) & both)
        pairs = store(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
        comps = _joined(comps, _confirm(pairs, sets.of(_ends(pairs).distinct()), percent))

        # Larger regions that are not in one component yet.
        hits = _with_comp(hits.filter(F.col("size") > SMALL), comps)
        several = hits.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        hits = store(hits.join(several.select("region"), "region"), "mixed-hits")
        if hits.isEmpty():
            break
        last = level + 1 == len(LEVELS)
        middle = hits if last else hits.filter(F.col("size") <= LARGE)
        comps = _joined(comps, _in_blocks(middle, sets.of(middle.select("node").distinct()), percent))
        if last:
            break
        large = hits.filter(F.col("size") > LARGE).select("node").distinct()
        if large.isEmpty():
            break
        active = nodes.select("node", "s1", "s2").join(sets.of(large), "node")
    return comps


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links; stored."""
    if comps is not None:
        links = store(links, "links")
        if links.isEmpty():
            return comps
        links = links.unionByName(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")))
    return store(components(links), "components")


def _in_blocks(hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in regions that are compared in blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = hits.select(
        "region", "node", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    )
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select(
        "region", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "node", "comp"
    )
    return _block_links(cells.join(sets, "node"), percent)
