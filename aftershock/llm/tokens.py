"""Byte-level BPE ids of many texts through the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aftershock.llm.common import documents_of, ids_type, kept_in_worker, slices, text_bytes
from aftershock.llm.words import IdStore

# White space beside blank, tab and line ends, on which two libraries might differ, in UTF-8.
_RARE_SPACE = (
    rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]"
    rb"|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf"
)
# Chunks whose ids a worker remembers.
REMEMBERED = 1_000_000


class ByteTokenizer:
    """Encodes texts exactly as the library does, without added special tokens.

    The pre-tokenizer never joins a visible character with a following space, a
    letter with a following sign, or a single line end with its neighbours, so
    texts are cut there.  The library is asked once for each different chunk;
    chunks are found by a hash and told apart by their bytes.  Texts with special
    strings or rare spaces are one chunk.  With ``plain``, special strings are
    ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.n = max(self.library.get_vocab(True).values()) + 1
        self.type = np.dtype(ids_type(self.n))
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.cut = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and told.get("normalizer") is None
        )
        self.library.encode_special_tokens = plain
        added = [] if plain else self.library.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        self.whole = re.compile(b"|".join([_RARE_SPACE, *map(re.escape, self.special)]))
        self.known = IdStore(self.type, REMEMBERED)

    @staticmethod
    def at(path: str, plain: bool = False) -> ByteTokenizer:
        return kept_in_worker(("tokenizer", path, plain), lambda: ByteTokenizer(path, plain))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Marks bytes with which a chunk begins."""
        cut = np.zeros(len(data) + 1, bool)
        if self.cut and len(data) > 1:
            kind = _KIND[data]
            letter = kind == 1
            # Two-byte letters end with a continuation byte.
            lead = np.flatnonzero(_LEAD[data[:-1]])
            second = data[lead + 1]
            low = np.where(data[lead] == 0xD0, 0x90, 0x80)
            high = np.where(data[lead] == 0xD1, 0x8F, 0xBF)
            sign = (data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))
            letter[lead[(second >= low) & (second <= high) & ~sign] + 1] = True
            space = kind == 2
            cut[1:-1] = space[1:] & ~space[:-1]
            cut[1:-1] |= (kind[1:] == 3) & letter[:-1]
            alone = (data[1:-1] == 10) & ~space[:-2] & ~space[2:]
            cut[2:-1] |= alone
            raw = data.tobytes()
            if _MAYBE_RARE[data].any() or any(x in raw for x in self.special):
                rows = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.whole.finditer(raw)}
                for k in rows:
                    cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets] = True
        return cut[:-1]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's."""
        data, offsets = text_bytes(column)
        if len(data) == 0:
            return np.zeros(0, self.type), np.zeros(len(offsets), np.int64)
        starts = np.flatnonzero(self._cuts(data, offsets))
        ids, before = self.known.encode(data, starts, self._ask)
        return ids, before[np.searchsorted(starts, offsets)]

    def _ask(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        return np.fromiter(chain.from_iterable(got), self.type, int(size.sum())), size


def _kinds() -> np.ndarray:
    """1: letter, 2: space, 3: visible ASCII that is no letter or digit, 0: any other byte."""
    kind = np.zeros(256, np.uint8)
    for c in range(33, 127):
        kind[c] = 0 if chr(c).isdigit() else 1 if chr(c).isalpha() else 3
    kind[[9, 10, 13, 32]] = 2
    return kind


_KIND = _kinds()
# First bytes of rare spaces.
_MAYBE_RARE = np.isin(np.arange(256), [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
# First bytes of two-byte letters: Latin from U+00C0 to U+023F and Russian.
_LEAD = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1])


def encode_documents(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text and ``end_id``: ``key, doc_id, n_tokens, width, ids``.

    ``key`` is unique and the same in every run over the same files; ``ids`` is
    binary, little-endian, ``width`` bytes an id.  A null text counts as empty;
    every row yields one row; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokenizer.at(tokenizer)
        kind = encoder.type if end_id <= np.iinfo(encoder.type).max else np.dtype("<u4")
        end = np.array([end_id], kind).tobytes()
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            flat, bounds = encoder.encode(batch.column("text"))
            flat, n = flat.astype(kind, copy=False), batch.num_rows
            ids = [flat[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + n)), batch.column("doc_id"),
                    pa.array(np.diff(bounds) + 1),
                    pa.array(np.full(n, kind.itemsize, np.int32)),
                    pa.array(ids, pa.binary()),
                ],
                ["key", "doc_id", "n_tokens", "width", "ids"],
            )
            key += n

    return documents_of(docs, id_col, text_col).mapInArrow(
        encode, "key long, doc_id long, n_tokens long, width int, ids binary"
    )
