"""Alignment of two tokenizers over a corpus: groups of tokens with common ends, and how often ids meet.

Most groups are one token of each tokenizer with the same bytes.  Which id of the
second belongs to an id of the first is known from the vocabularies, so such groups
are counted in one vector as long as the first vocabulary.  Only pairs of ids from
other groups are counted by a shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import documents_of, kept_in_worker, slices, text_bytes
from aftershock.llm.token_counts import _Counter
from aftershock.llm.tokens import ByteTokenizer
from aftershock.session import new_path

# Pairs whose counts are sent to all tasks, at most; the others are joined.
HOT_PAIRS = 1 << 17
# Pairs that a task holds before it counts them.
_HELD = 1 << 21
_ALIGNED = (
    "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, {groups} string, "
    "same binary, odd binary, times binary"
)


class Vocabulary:
    """The bytes of all ids of a vocabulary in a row."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        size = self.size[ids]
        stop = np.cumsum(size)
        if len(ids) == 0:
            return np.zeros(0, np.uint8)
        return self.data[np.repeat(self.first[ids] - (stop - size), size) + np.arange(stop[-1])]


def byte_level_tokens(tokenizer) -> list[bytes]:
    """Bytes of all ids of a byte-level vocabulary, whose tokens are written in visible characters."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    ids = tokenizer.get_vocab(True)
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of all ids of a piece vocabulary."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(pieces)
    ]


class Aligner:
    """Both tokenizers, their bytes, and the second's id for each id of the first with the same bytes (or -1)."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece

        self.a = ByteTokenizer.at(byte_bpe, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.split = kept_in_worker(("counter", pieces), lambda: _Counter(pieces)).split
        a, b = byte_level_tokens(self.a.library), piece_tokens(self.b)
        self.a_bytes, self.b_bytes = Vocabulary(a), Vocabulary(b)
        # Of pieces with the same bytes the plain one, which comes after the single bytes.
        id_of = {t: i for i, t in enumerate(b) if t and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([id_of.get(t, -1) for t in a], np.int64)
        self.written = [_written(len(a), b",|"), _written(len(b), b",;")]

    @staticmethod
    def at(byte_bpe: str, pieces: str) -> Aligner:
        return kept_in_worker(("aligner", byte_bpe, pieces), lambda: Aligner(byte_bpe, pieces))

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their offsets; long texts are encoded in parts."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = self.split(text)
            parts += own
            owner += [i] * len(own)
        ids = self.b.encode(parts, num_threads=1)
        n = np.bincount(owner, [len(x) for x in ids], len(texts)).astype(np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        return flat, np.concatenate([[0], np.cumsum(n)])

    def align(self, column: pa.Array) -> Alignment:
        """Tokens and links of all texts of a column; texts that do not come back have none."""
        column = pc.fill_null(column, "")
        data, offsets = text_bytes(column)
        a, a_at = self.a.encode(pc.binary_join_element_wise(" ", column, ""))
        b, b_at = self.encode_b(column.to_pylist())
        size = np.diff(offsets)
        expected = np.full(len(data) + len(size), 32, np.uint8)
        begin = offsets[:-1] + np.arange(len(size))
        expected[np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1), size)] = data
        good = size > 0
        sides = []
        for ids, at, table in ((a, a_at, self.a_bytes), (b, b_at, self.b_bytes)):
            ids = ids.astype(np.int64)
            total = np.concatenate([[0], np.cumsum(table.size[ids])])[at]
            good &= np.diff(total) == size + 1
            sides.append((ids, at, table))
        for ids, at, table in sides:  # the bytes of texts with the right lengths
            chosen, bytes_ = _rows(ids, at, good), _rows(expected, np.append(begin, len(expected)), good)
            wrong = np.flatnonzero(table.joined(chosen) != bytes_)
            if len(wrong):
                stops = np.cumsum(size[good] + 1)
                lost = np.flatnonzero(good)[np.unique(np.searchsorted(stops, wrong, "right"))]
                good[lost] = False
        (a, a_at, _), (b, b_at, _) = sides
        return Alignment(self, good, _rows(a, a_at, good), np.diff(a_at) * good, _rows(b, b_at, good), np.diff(b_at) * good)


def _rows(values: np.ndarray, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The values of the rows to keep."""
    return values if keep.all() else values[np.repeat(keep, np.diff(at))]


def _written(n: int, marks: bytes) -> np.ndarray:
    """Ids in decimal with each of the marks behind, as fixed-width strings."""
    return np.array([[b"%d%c" % (i, m) for i in range(n)] for m in marks])


class Alignment:
    """Aligned tokens of some texts; ``a`` and ``b`` are the ids of all texts in a row."""

    def __init__(self, aligner: Aligner, good: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.aligner, self.a, self.b, self.n_a, self.n_b = aligner, a, b, n_a, n_b
        a_ends, b_ends = np.cumsum(aligner.a_bytes.size[a]), np.cumsum(aligner.b_bytes.size[b])
        # Ends as marks on all byte places; counts of marks number the tokens, links and groups.
        in_a, in_b = (np.zeros((int(e[-1]) if len(e) else 0) + 1, bool) for e in (a_ends, b_ends))
        in_a[a_ends], in_b[b_ends] = True, True
        upto_a, upto_b, upto_cut = (np.cumsum(m, dtype=np.int32) for m in (in_a, in_b, in_a & in_b))
        # Between two neighbouring ends lies exactly one token of each side: a link.
        ends = np.flatnonzero(in_a | in_b)
        self.link_a, self.link_b = a[upto_a[ends - 1]], b[upto_b[ends - 1]]
        self.a_last, self.b_last = in_b[a_ends], in_a[b_ends]
        self.a_group, self.b_group = upto_cut[a_ends - 1], upto_cut[b_ends - 1]
        groups = int(upto_cut[-1])
        self.many_a, self.many_b = (np.bincount(g, minlength=groups) for g in (self.a_group, self.b_group))
        single = (self.many_a == 1) & (self.many_b == 1)
        # One token of each side, with the ids that the vocabularies give.
        single[single] = aligner.same[a[single[self.a_group]]] == b[single[self.b_group]]
        self.a_single, self.link_odd = single[self.a_group], ~single[upto_cut[ends - 1]]
        self.a_at = np.cumsum(np.concatenate([[0], n_a]))  # offsets of each text's tokens
        reach = np.concatenate([[0], a_ends])[self.a_at]
        self.group_at = upto_cut[reach].astype(np.int64)
        # Every end of A, and those of B that are not ends of A.
        self.link_at = self.a_at + upto_b[reach] - upto_cut[reach]

    def groups(self) -> list[bytes]:
        """The groups of each text, written as ``a1,a2|b1;a3|b2,b3``."""
        before_b = np.cumsum(self.many_b) - self.many_b
        upto_a = np.cumsum(self.many_a)
        written_a, written_b = self.aligner.written
        width = max(written_a.dtype.itemsize, written_b.dtype.itemsize)
        out = np.zeros(len(self.a) + len(self.b), f"S{width}")
        out[np.arange(len(self.a)) + before_b[self.a_group]] = written_a[self.a_last.astype(int), self.a]
        out[np.arange(len(self.b)) + upto_a[self.b_group]] = written_b[self.b_last.astype(int), self.b]
        letters = out.view(np.uint8).reshape(len(out), width)
        used = letters != 0
        size = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        raw = letters[used].tobytes()
        at = size[np.cumsum(np.concatenate([[0], self.n_a + self.n_b]))].tolist()
        return [raw[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]

    def odd_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of ids of links that do not join single tokens, their numbers, and offsets of each text."""
        n_pairs = len(self.aligner.a_bytes.size) * len(self.aligner.b_bytes.size)
        text = np.repeat(np.arange(len(self.n_a)), np.diff(self.link_at))[self.link_odd]
        pair = self.link_a[self.link_odd] * len(self.aligner.b_bytes.size) + self.link_b[self.link_odd]
        # Texts of a slice are few, so number and pair fit into 64 bits; vocabularies too large for that are not.
        if n_pairs * max(1, len(self.n_a)) >= 1 << 63:
            raise ValueError("vocabularies too large")
        both, times = np.unique(text * n_pairs + pair, return_counts=True)
        at = np.searchsorted(both, np.arange(len(self.n_a) + 1) * n_pairs)
        return both % n_pairs, times, at


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _aligned(docs: DataFrame, byte_bpe: str, pieces: str, hashed: bool) -> DataFrame:
    """One row for each document: numbers, groups, ids of single tokens, and pairs of the others with their numbers."""
    name = "groups_sha256" if hashed else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.at(byte_bpe, pieces)
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            n = batch.num_rows
            found = aligner.align(batch.column("text"))
            odd, times, at = found.odd_pairs()
            groups = found.groups()
            if hashed:
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            kept = found.a[found.a_single].astype("<u4")
            kept_at = np.concatenate([[0], np.cumsum(found.a_single)])[found.a_at]

            def cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
                each = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                return pa.array([values[x:y].tobytes() for x, y in each], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + n)), batch.column("doc_id"), pa.array(found.n_a), pa.array(found.n_b),
                    pa.array(np.diff(found.group_at)), pa.array(np.diff(found.link_at)),
                    pa.array([g if hashed else g.decode() for g in groups], pa.string()),
                    cut(kept, kept_at), cut(odd.astype("<u8"), at), cut(times.astype("<u4"), at),
                ],
                ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", name, "same", "odd", "times"],
            )
            key += n

    return docs.mapInArrow(run, _ALIGNED.format(groups=name))


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, and the row of each."""
    values = np.frombuffer(b"".join(column.to_pylist()), kind)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return values, np.repeat(np.arange(len(column)), sizes)


def _pair_counts(aligned: DataFrame, same: np.ndarray, n_b: int) -> DataFrame:
    """``pair, n`` of all linked ids (``a * n_b + b``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = np.zeros(len(same), np.int64)
        pairs, numbers, held = [], [], 0

        def counted() -> pa.RecordBatch:
            pair, which = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(which, np.concatenate(numbers), len(pair)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            singles += np.bincount(_flat(batch.column("same"), "<u4")[0], minlength=len(same))
            pairs.append(_flat(batch.column("odd"), "<u8")[0])
            numbers.append(_flat(batch.column("times"), "<u4")[0])
            held += len(pairs[-1])
            if held > _HELD:
                yield counted()
                pairs, numbers, held = [], [], 0
        if pairs:
            yield counted()
        at = np.flatnonzero(singles)
        yield pa.RecordBatch.from_arrays([pa.array(at * n_b + same[at]), pa.array(singles[at])], ["pair", "n"])

    return aligned.select("same", "odd", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _hot_bound(pairs: DataFrame) -> int:
    """A count that at most ``HOT_PAIRS`` pairs reach."""
    level = F.floor(F.log2("n") * 16)
    levels = pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least"))
    total, bound = 0, 1 << 62
    for row in sorted(levels.collect(), key=lambda r: -r["level"]):  # some hundred rows
        total += row["pairs"]
        if total > HOT_PAIRS:
            break
        bound = row["least"]
    return bound


def align_tokens(
    docs: DataFrame,
    byte_bpe: str,
    pieces: str,
    hashed: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """How the tokens of a byte-level BPE (A) and of a piece model (B) lie over each other in every text.

    A encodes a blank and the text, B the text, to which it adds the blank;
    strings of special tokens are plain text.  Byte places where tokens of both
    sides end cut a text into groups.  A link is an A and a B token whose bytes
    overlap; a pair's count is the number of its links in the whole table.  Texts that
    are null or empty, or whose tokens' bytes are not blank and text (as where
    B's normaliser changes it), have no tokens.

    Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best`` (links whose count is
    the highest of their B id, ties included), ``count_sum`` (over links) and
    ``groups``, written as ``a1,a2|b1;a3|b2,b3`` (or ``groups_sha256``, their
    SHA-256, with ``hashed``; '' without tokens).  Every row gives one row, also
    repeated ones, which count each; an empty table gives none; other columns are
    not read.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    aligner = Aligner.at(byte_bpe, pieces)
    same, n_a, n_b = aligner.same, len(aligner.a_bytes.size), len(aligner.b_bytes.size)
    aligned = _stored(_aligned(documents_of(docs, id_col, text_col), byte_bpe, pieces, hashed), "aligned")
    pairs = _stored(_pair_counts(aligned, same, n_b), "pairs")

    # Vectors as long as the vocabularies, and the counts of the most frequent pairs.
    b_id = F.col("pair") % n_b
    top = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("best"))
    best = np.zeros(n_b, np.int64)
    for row in top.collect():
        best[row["b"]] = row["best"]
    spark = docs.sparkSession
    owned = np.flatnonzero(same >= 0)
    wanted = spark.createDataFrame([(int(p),) for p in owned * n_b + same[owned]], "pair long")
    singles = np.zeros(n_a, np.int64)
    for row in pairs.join(F.broadcast(wanted), "pair").collect():
        singles[row["pair"] // n_b] = row["n"]
    bound = _hot_bound(pairs)
    hot = pairs.filter(F.col("n") >= bound).toArrow().sort_by("pair")
    hot_pair, hot_n = hot.column("pair").to_numpy(), hot.column("n").to_numpy()
    hot_top = hot_n == best[hot_pair % n_b]
    single_top = (same >= 0) & (singles == best[same])

    def place(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs lie among the frequent ones, and which do."""
        at = np.minimum(np.searchsorted(hot_pair, pair), max(0, len(hot_pair) - 1))
        return at, hot_pair[at] == pair if len(hot_pair) else np.zeros(len(pair), bool)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = batch.num_rows, []
            ids, row = _flat(batch.column("same"), "<u4")
            pair, of = _flat(batch.column("odd"), "<u8")
            times = _flat(batch.column("times"), "<u4")[0].astype(np.int64)
            at, known = place(pair.astype(np.int64))
            at, of, times = at[known], of[known], times[known]
            for one, many in ((singles[ids], hot_n[at] * times), (single_top[ids], hot_top[at] * times)):
                total = np.zeros(n, np.int64)
                np.add.at(total, row, one.astype(np.int64))
                np.add.at(total, of, many.astype(np.int64))
                out.append(pa.array(total))
            names = batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, "count_sum", "n_best"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, of = _flat(batch.column("odd"), "<u8")
            pair = pair.astype(np.int64)
            left = ~place(pair)[1]
            key = batch.column("key").to_numpy()[of[left]]
            times = _flat(batch.column("times"), "<u4")[0][left].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pair[left]), pa.array(times)], ["key", "pair", "times"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields[:-3])
    whole = aligned.mapInArrow(summed, f"{schema}, count_sum long, n_best long")
    counts = pairs.filter(F.col("n") < bound).withColumn("b", b_id).join(F.broadcast(top), "b")
    counts = counts.select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    rest = (
        aligned.select("key", "odd", "times").mapInArrow(rare, "key long, pair long, times long").join(counts, "pair")
        .groupBy("key")
        .agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("_top"))
    )
    more = {"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_top", F.lit(0))}
    return whole.join(rest, "key", "left").withColumns(more).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if hashed else "groups"
    )
