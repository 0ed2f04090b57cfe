"""Token counts without the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import documents_of, kept_in_worker, slices, text_bytes

# Texts above this many characters are counted in parts.
PART_CHARS = 1 << 16


class _Counter:
    """Counts by the library that belongs to the file's name."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            # A part gets the blank in front that the cut took away, if the model
            # adds one to a text and keeps repeated blanks, and no piece runs
            # from a visible character over a blank.
            kept = model.encode("a  b", out_type=str) != model.encode("a b", out_type=str)
            leads = "".join(model.encode("a", out_type=str)).startswith("▁")
            self.parts = leads and kept and not inner
        else:
            from aftershock.llm.tokens import ByteTokenizer

            encoder = ByteTokenizer.at(path)
            self.count = lambda texts: np.diff(encoder.encode(pa.array(texts, pa.string()))[1])
            self.parts = False

    def split(self, text: str) -> list[str]:
        """Parts whose counts add up to the count of the whole text."""
        if not self.parts or len(text) <= PART_CHARS:
            return [text]
        out, start = [], 0
        while len(text) - start > PART_CHARS:
            at = start + PART_CHARS
            while True:
                at = text.find(" ", at)
                if at < 0 or text[at - 1] not in " ▁":
                    break
                at += 1
            if at < 0 or at + 1 >= len(text):
                break
            out.append(text[start:at])
            start = at + 1
        return [*out, text[start:]]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text, as the library gives them without added tokens.

    Columns: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (more than ``limit`` tokens).  Every row yields one row, repeated ids too; a
    null text counts as empty (0 tokens); an empty table gives no rows; other
    columns are not read.  Batches are cut by bytes and long texts at blanks
    between visible characters, so memory follows neither rows nor texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("counter", tokenizer), lambda: _Counter(tokenizer))
        for batch in slices(batches, "text"):
            parts, owner = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = counter.split(text)
                parts += own
                owner += [i] * len(own)
            n = np.bincount(owner, counter.count(parts), batch.num_rows).astype(np.int64)
            sizes = np.diff(text_bytes(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(n)],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = documents_of(docs, id_col, text_col).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
