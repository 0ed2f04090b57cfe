"""Removal of repeated byte strings by a distributed merge sort of suffixes.

1.  Every text gives its anchors (see ``suffixes``).  Anchors whose first bytes occur
    nowhere else, told by counted hashes, cannot begin a repeated string and go.
2.  Tasks sort the other suffixes and send front-coded runs to parts; a part holds all
    suffixes with the same first bytes, unless these are too many, then several parts do.
3.  A part merges its runs with a tree of losers, which gives the suffixes in order with
    their common prefixes, and from these the strings that occur more than once.
4.  Strings whose suffixes lie in several parts are counted across parts by a 128-bit
    hash, one row for each different string of a part.

Equal texts are one text from the start, told by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm import suffixes
from aftershock.llm.common import documents_of, slices, store, text_bytes

# Suffixes of a part, about; places with one hash beyond this many are dealt to several parts.
PART_SUFFIXES = 1 << 15
# Suffixes that a task sorts at once.
RUN_SUFFIXES = 1 << 15
# Bytes of a table that may be sent to all tasks.
BROADCAST_BYTES = 16 << 20
_RUN = "part long, shared binary, rests binary, n int, uid binary, place binary, low binary, high binary, times binary, split binary"
_FOUND = "uid long, begin int, stop int, h1 long, h2 long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = documents_of(docs, id_col, text_col)
    return texts.withColumn("th", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _anchored(texts: DataFrame, span: int) -> DataFrame:
    """``uid, th, copies, at`` of each different text with ``span`` bytes; stored."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            text, place, low, high, seed = suffixes.anchors(data, offsets, span)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            packed = (place << 32) | (low << 16) | high
            rows = pa.StructArray.from_arrays([pa.array(packed), pa.array(seed.view(np.int64))], ["at", "seed"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("th"), pa.ListArray.from_arrays(pa.array(bounds), rows)], ["th", "anchors"]
            )

    found = (
        texts.filter(F.octet_length("text") >= span)
        .select("th", "text")
        .mapInArrow(find, "th binary, anchors array<struct<at:long,seed:long>>")
    )
    once = found.groupBy("th").agg(F.first("anchors").alias("anchors"), F.count(F.lit(1)).alias("copies"))
    return store(once.select(F.monotonically_increasing_id().alias("uid"), "th", "copies", "anchors"), "anchors")


def _candidates(texts: DataFrame) -> tuple[DataFrame, int]:
    """``th, uid, wanted`` of texts with anchors whose hash occurs again, stored, and the number of parts."""
    posts = texts.select("uid", F.explode("anchors").alias("a")).select("uid", "a.at", "a.seed")
    seeds = posts.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeds = store(seeds, "seeds")
    parts = max(1, -(-(seeds.agg(F.sum("n")).first()[0] or 0) // PART_SUFFIXES))
    pieces = F.ceil(F.col("n") / PART_SUFFIXES)
    part = F.pmod(F.xxhash64("seed", F.pmod(F.xxhash64("uid"), pieces)), F.lit(parts))
    posts = posts.join(seeds, "seed").select("uid", F.struct("at", part.alias("part"), (pieces > 1).alias("split")).alias("want"))
    lists = posts.groupBy("uid").agg(F.collect_list("want").alias("wanted"))
    return store(texts.select("uid", "th").join(lists, "uid"), "candidates"), parts


def _runs(texts: DataFrame, span: int) -> DataFrame:
    """Sorted front-coded runs of the wanted suffixes, cut by part; rows come with ``uid, wanted, text``."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in slices(batches, "text"):
            uid = batch.column("uid").to_numpy()
            # Copies of a text follow each other.
            new = np.flatnonzero(np.diff(uid, prepend=uid[:1] - 1 if last is None else last) != 0)
            last = uid[-1:]
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            for i in new.tolist():
                want = wanted[i].values
                at, part = (want.field(c).to_numpy() for c in ("at", "part"))
                split = want.field("split").to_numpy(zero_copy_only=False)
                place, low, high = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
                own = data[offsets[i] : offsets[i + 1]]
                for a in range(0, len(at), RUN_SUFFIXES):
                    s = slice(a, a + RUN_SUFFIXES)
                    keys = suffixes.contexts(own, place[s], low[s], high[s], span)
                    rows = len(keys)
                    held.append((part[s], keys, np.full(rows, uid[i]), place[s], low[s], high[s], split[s]))
                    n += rows
                    if n >= RUN_SUFFIXES:
                        yield from _cut(held)
                        held, n = [], 0
        if held:
            yield from _cut(held)

    return texts.select("uid", "wanted", "text").mapInArrow(sort, _RUN)


def _cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One sorted run as a row for each part; suffixes with equal keys are one with several places."""
    part, keys, uid, place, low, high, split = (np.concatenate(x) for x in zip(*held, strict=True))
    # Places of one suffix in order; equal keys of other distances differ.
    order = np.lexsort((place, uid, high, low))
    order = order[suffixes.sorted_order(keys[order])]
    order = order[np.argsort(part[order], kind="stable")]
    part, keys, uid, place, low, high, split = (x[order] for x in (part, keys, uid, place, low, high, split))
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k, u, p, lo, hi = keys[a:b], uid[a:b], place[a:b], low[a:b], high[a:b]
        new = np.ones(b - a, bool)
        new[1:] = (k[1:] != k[:-1]).any(axis=1) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        first = np.flatnonzero(new)
        shared, rests = suffixes.front_coded(k[first])
        times = np.diff(first, append=b - a)
        columns = {"part": pa.array([part[a]], pa.int64()), "shared": [shared.tobytes()], "rests": [rests]}
        columns |= {"n": pa.array([len(first)], pa.int32()), "uid": [u.astype("<i8").tobytes()], "place": [p.astype("<i4").tobytes()]}
        columns |= {"low": [lo[first].astype("<u2").tobytes()], "high": [hi[first].astype("<u2").tobytes()]}
        columns |= {"times": [times.astype("<u4").tobytes()], "split": [split[a:b][first].astype(np.uint8).tobytes()]}
        yield pa.RecordBatch.from_pydict(columns)


def _merge(span: int):
    """Merges the runs of a part and finds its repeated strings."""
    length = 2 * span - span // 2

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        runs = [(np.frombuffer(r["shared"], "<u2"), r["rests"]) for r in rows]
        member = {
            "uid": [np.frombuffer(r["uid"], "<i8") for r in rows],
            "place": [np.frombuffer(r["place"], "<i4") for r in rows],
        }
        own = {c: [np.frombuffer(r[c], t) for r in rows] for c, t in (("low", "<u2"), ("high", "<u2"), ("times", "<u4"), ("split", "u1"))}
        taken, keys, shared = [], [], []
        for run, key, same in suffixes.merged(runs, length):
            taken.append(run)
            keys.append(key)
            shared.append(same)
        taken, shared = np.array(taken), np.array(shared)
        keys = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, length)
        # Each run's suffixes come in their order.
        source = np.empty(len(taken), np.int64)
        source[np.argsort(taken, kind="stable")] = np.arange(len(taken))
        low, high, times, split = (np.concatenate(own[c])[source].astype(np.int64) for c in ("low", "high", "times", "split"))
        begin = np.cumsum(np.concatenate(own["times"]).astype(np.int64))[source] - times
        pick = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
        uid, place = (np.concatenate(member[c])[pick].astype(np.int64) for c in ("uid", "place"))
        owner = np.repeat(np.arange(len(taken)), times)

        # A text that came several times has its places once; equal keys may also lie in several runs.
        same_key = np.cumsum(shared < length)
        columns = [place, uid, high[owner], low[owner], same_key[owner]]
        order = np.lexsort(columns)
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        order = order[new]
        order = order[np.argsort(owner[order], kind="stable")]
        uid, place, owner = uid[order], place[order], owner[order]
        times = np.bincount(owner, minlength=len(taken))
        found, key, distance = suffixes.repeated(keys, shared, low, high, times, span)

        edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        at, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        # All places of these keys.
        many = times[at]
        start = np.searchsorted(owner, at) - (np.cumsum(many) - many)
        pick = np.repeat(start, many) + np.arange(many.sum())
        out_uid, out_begin = [uid[pick]], [place[pick] - np.repeat(last, many)]
        out_stop = [place[pick] - np.repeat(first, many) + span]
        h1 = [np.zeros(len(pick), np.int64)] * 2
        known = [np.ones(len(pick), bool)]

        # One row for each different string of suffixes that other parts hold as well.
        far = split[key] > 0
        key, distance = key[far], distance[far]
        if len(key):
            single = ~found[key, distance]
            one = np.searchsorted(owner, key)
            digests = b"".join(
                xxhash.xxh3_128_digest(keys[i, span : span + d][::-1].tobytes() + keys[i, : span - d].tobytes())
                for i, d in zip(key.tolist(), distance.tolist(), strict=True)
            )
            halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
            out_uid.append(np.where(single, uid[one], -1))
            out_begin.append(place[one] - distance)
            out_stop.append(place[one] - distance + span)
            h1 = [np.concatenate([h, halves[:, i]]) for i, h in enumerate(h1)]
            known.append(np.zeros(len(key), bool))
        mask = np.concatenate(known)
        return pa.table(
            {
                "uid": pa.array(np.concatenate(out_uid), pa.int64()),
                "begin": pa.array(np.concatenate(out_begin).astype(np.int32)),
                "stop": pa.array(np.concatenate(out_stop).astype(np.int32)),
                "h1": pa.array(h1[0], pa.int64(), mask=mask), "h2": pa.array(h1[1], pa.int64(), mask=mask),
            }
        )

    return merge


def repeated_spans(docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """``th`` (SHA-256 of the text), ``copies`` and ``spans`` (sorted, apart) of texts with repeated strings; stored."""
    texts = _texts(docs, id_col, text_col)
    known = _anchored(texts, span)
    wanted, parts = _candidates(known)
    runs = _runs(texts.select("th", "text").join(wanted, "th"), span)
    found = store(runs.groupBy("part").applyInArrow(_merge(span), _FOUND), "found-strings")

    far = found.filter("h1 IS NOT NULL")
    # A string that its part knows as repeated has no place of its own here but counts.
    again = far.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = far.filter("uid >= 0").join(again, ["h1", "h2"], "leftsemi").select("uid", "begin", "stop")
    spans = found.filter("h1 IS NULL").select("uid", "begin", "stop").unionByName(again)
    lists = spans.groupBy("uid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            begin, stop = (column.flatten().field(c).to_numpy().astype(np.int64) for c in ("begin", "stop"))
            row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
            order = np.lexsort((begin, row))
            row, begin, stop = row[order], begin[order], stop[order]
            far = row << 32  # rows do not touch each other
            reach = np.maximum.accumulate(stop + far) if len(row) else stop
            new = np.ones(len(row), bool)
            new[1:] = begin[1:] + far[1:] > reach[:-1]
            first = np.flatnonzero(new)
            ends = reach[np.append(first[1:], len(row)) - 1] - far[first] if len(row) else reach
            bounds = np.searchsorted(row[first], np.arange(len(column) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays(
                [pa.array(begin[first].astype(np.int32)), pa.array(ends.astype(np.int32))], ["begin", "stop"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.ListArray.from_arrays(pa.array(bounds), rows)], ["uid", "spans"]
            )

    lists = lists.mapInArrow(unite, "uid long, spans array<struct<begin:int,stop:int>>")
    cuts = known.select("uid", "th", "copies").join(lists, "uid", "left").filter("copies > 1 OR spans IS NOT NULL")
    return store(cuts.select("th", "copies", F.when(F.col("copies") == 1, F.col("spans")).alias("spans")), "spans")


def drop_repeated_strings(
    docs: DataFrame, span: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents' bytes without those that a repeated string of ``span`` bytes covers.

    Texts are UTF-8 bytes; a string of ``span`` bytes is repeated if it also
    begins at any other place of the table, in the same text or another, also
    overlapping; strings do not cross texts.  All copies go, the first too.
    Columns: ``doc_id``, ``text`` (null: empty), ``removed``
    (array of struct ``begin, stop``, byte places, sorted, apart) and ``kept``
    (binary; cuts may fall into a character).  Every row gives one row; repeated
    rows are copies of each other; rows without an id count like others; texts
    shorter than ``span`` stay whole; an empty table gives no rows; other columns
    are not read.
    """
    if not 2 <= span < 1 << 16:
        raise ValueError("span must have from 2 to 65535 bytes")
    cuts = repeated_spans(docs, span, id_col, text_col)
    size = cuts.agg(F.sum(48 + 8 * F.greatest(F.size("spans"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    joined = _texts(docs, id_col, text_col).join(cuts, "th", "left")
    raw, length = F.col("text").cast("binary"), F.octet_length("text")
    whole = F.array(F.struct(F.lit(0).alias("begin"), length.alias("stop")))
    none = F.array().cast("array<struct<begin:int,stop:int>>")
    removed = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", none))
    # What lies between the removed spans.
    begins = F.concat(F.array(F.lit(0)), F.col("removed.stop"))
    stops = F.concat(F.col("removed.begin"), F.array(length))
    between = F.arrays_zip(begins.alias("a"), stops.alias("b"))
    kept = F.aggregate(
        between, F.lit(b""), lambda done, x: F.concat(done, F.substring(raw, x["a"] + 1, x["b"] - x["a"]))
    )
    joined = joined.withColumn("removed", removed)
    return joined.select(
        "doc_id", "text", "removed", F.when(F.size("removed") == 0, raw).otherwise(kept).alias("kept")
    )
