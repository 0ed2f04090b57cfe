"""Token files: independent zstandard frames, a seek table at the end, checksums per frame.

Layout of a file (the public seekable zstandard format, so any decoder reads the
ids back in one go):

* data frames, each at most ``FRAME_BYTES`` of little-endian ids when unpacked;
* a skippable frame with the document index (zstandard-packed arrays: a flag
  whether the id is set, the id, the number of ids);
* a skippable frame with the seek table: per data frame its packed size, its
  size and the low 32 bits of the XXH64 of its bytes.

Writers name a file after the attempt, and a manifest table lists the files of
the attempts that succeeded; a lost executor leaves at most an unlisted file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aftershock.llm.common import crc_of, documents_of, slices
from aftershock.llm.tokens import ByteTokenizer

FRAME_BYTES = 1 << 20
_INDEX, _TABLE, _END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MANIFEST = "part int, file string, n_docs long, n_tokens long"


def _disk(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Writer:
    """Appends ids of one document after the other to one file."""

    def __init__(self, stream, level: int):
        import xxhash
        import zstandard

        self.out, self.sum = stream, xxhash.xxh64_intdigest
        self.pack = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes, n: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= FRAME_BYTES:
            raw = b"".join(self.held)
            full = len(raw) // FRAME_BYTES * FRAME_BYTES
            for at in range(0, full, FRAME_BYTES):
                self._frame(raw[at : at + FRAME_BYTES])
            self.held, self.held_bytes = [raw[full:]], len(raw) - full

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), self.sum(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held_bytes:
            self._frame(b"".join(self.held))
        known = np.array([x is not None for x in self.ids], np.uint8)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        index = self.pack.compress(
            known.tobytes() + ids.tobytes() + np.array(self.lengths, "<i8").tobytes()
        )
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        tail = struct.pack("<IBI", len(self.frames), 0x80, _END)
        self.out.write(struct.pack("<II", _TABLE, len(table) + len(tail)) + table + tail)
        self.out.close()


class TokenFile:
    """One file, read in ranges: the tables first, then frames that are asked for."""

    def __init__(self, disk, path: str):
        self.file = disk.open_input_file(path)
        size = self.file.size()
        n, _, end = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if end != _END:
            raise ValueError(f"{path} has no seek table")
        table_at = size - 9 - 12 * n - 8
        table = np.frombuffer(self.file.read_at(12 * n, table_at + 8), "<u4").reshape(n, 3)
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.raw = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        self.sums = table[:, 2]
        import zstandard

        self.unpack = zstandard.ZstdDecompressor()
        at = int(self.packed[-1])
        index = self.unpack.decompress(self.file.read_at(table_at - at - 8, at + 8))
        docs = len(index) // 17
        known = np.frombuffer(index, np.uint8, docs)
        ids = np.frombuffer(index, "<i8", docs, docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(index, "<i8", docs, 9 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        total = int(self.starts[-1])
        self.type = np.dtype(f"<u{int(self.raw[-1]) // total}" if total else "<u4")
        self.last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            a, b = int(self.packed[k]), int(self.packed[k + 1])
            raw = self.unpack.decompress(self.file.read_at(b - a, a))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the document at this position; unpacks the frames it touches only."""
        width = self.type.itemsize
        a, b = int(self.starts[doc]) * width, int(self.starts[doc + 1]) * width
        if a == b:
            return np.zeros(0, self.type)
        first = int(np.searchsorted(self.raw, a, "right")) - 1
        last = int(np.searchsorted(self.raw, b, "left")) - 1
        parts = [
            self._frame(k)[max(0, a - int(self.raw[k])) : b - int(self.raw[k])]
            for k in range(first, last + 1)
        ]
        return np.frombuffer(b"".join(parts), self.type)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
    level: int = 3,
) -> DataFrame:
    """Encodes every document, appends ``end_id`` and writes files in ascending id order.

    ``folder`` is on storage that all executors share.  Null texts count as
    empty; documents without an id come first; rows of one id are neighbours,
    ordered by their text's hash; empty tables write nothing.  Other columns are
    not read.  Returns the manifest, which is also stored in ``folder/manifest``.
    """
    spark = docs.sparkSession
    rows = documents_of(docs, id_col, text_col)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash keeps one id with many rows from being one range.
    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_tie")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokenizer.at(tokenizer)
        kind = encoder.type if end_id <= np.iinfo(encoder.type).max else np.dtype("<u4")
        end = np.array([end_id], kind).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}.zst"
        writer, tokens = None, 0
        for batch in slices(batches, "text"):
            if writer is None:
                disk, top = _disk(folder)
                disk.create_dir(top, recursive=True)
                writer = _Writer(disk.open_output_stream(f"{top}/{name}", compression=None), level)
            flat, bounds = encoder.encode(batch.column("text"))
            flat = flat.astype(kind, copy=False)
            bounds = bounds.tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                writer.add(doc_id, flat[a:b].tobytes() + end, b - a + 1)
            tokens += len(flat) + batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "file": [name],
                    "n_docs": pa.array([len(writer.ids)], pa.int64()),
                    "n_tokens": pa.array([tokens], pa.int64()),
                }
            )

    path = f"{folder}/manifest"
    ordered.mapInArrow(write, _MANIFEST).write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


def read_token_files(
    spark: SparkSession, folder: str, doc_ids: Sequence[int] | None = None, with_ids: bool = True
) -> DataFrame:
    """Documents of a folder of token files, or of the given ids only.

    Columns: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (unsigned, over little-endian unsigned 32-bit ids) and, if
    wanted, ``ids``.  Only frames with wanted documents are fetched and unpacked;
    each is checked against its checksum.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # One row per file, so this window is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        schema, names = f"{schema}, ids array<long>", [*names, "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                disk, top = _disk(folder)
                file = TokenFile(disk, f"{top}/{row['file']}")
                rows: list[tuple] = []
                held = 0
                for k, doc_id in enumerate(file.doc_ids):
                    if wanted is not None and doc_id not in wanted:
                        continue
                    ids = file.ids(k)
                    start = row["base"] + int(file.starts[k])
                    made = (doc_id, start, len(ids), crc_of(ids))
                    rows.append((*made, ids.astype(np.int64)) if with_ids else made)
                    held += len(ids) if with_ids else 1
                    if held >= 100_000:
                        yield _table(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _table(rows, names)

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, schema)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=False)]
    return pa.RecordBatch.from_arrays(arrays, names)
