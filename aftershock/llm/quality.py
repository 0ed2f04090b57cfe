"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader steps.

Features of a text: words and pairs of neighbouring words as they are written,
runs of one to three word shapes (``Abc!`` and ``Xyz!`` have one shape), and
whether a word equals one of the words just before it.  Each kind of feature is
a vector of square roots of shares, so a text's length does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import documents_of, mixed, slices, text_bytes
from aftershock.llm.words import is_space, span_hashes, spans

BITS = 18
# Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 8192
EPOCHS = 3
_KINDS = np.array([mixed(np.array([k + 1], np.uint64))[0] for k in range(6)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, feature numbers and values, sorted by text; feature 0 is 1 for every text."""
    n = len(offsets) - 1
    starts, ends, text = spans(~is_space(data), offsets)
    h = span_hashes(data, starts, ends)
    shape = _shapes(data, starts, ends)
    texts, keys, kinds = [], [], []

    def add(kind: int, owner: np.ndarray, key: np.ndarray) -> None:
        texts.append(owner)
        keys.append(mixed(key ^ _KINDS[kind]))
        kinds.append(np.full(len(owner), kind))

    def run(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        k = max(len(values) - size + 1, 0)
        at = np.flatnonzero(text[:k] == text[size - 1 : size - 1 + k])
        key = np.full(len(at), size, np.uint64)
        for i in range(size):
            key = mixed(key + values[at + i])
        return text[at], key

    add(0, text, h)
    add(1, *run(h, 2))
    for size in (1, 2, 3):
        add(1 + size, *run(shape, size))
    for lag in (1, 2, 3, 4):
        at = np.flatnonzero(text[lag:] == text[: max(len(text) - lag, 0)]) + lag
        same = (h[at] == h[at - lag]).astype(np.uint64)
        add(5, text[at], same * np.uint64(8) + np.uint64(lag))
    owner, key, kind = np.concatenate(texts), np.concatenate(keys), np.concatenate(kinds)
    number = (key >> np.uint64(64 - BITS)).astype(np.int64)
    cell = ((owner * len(_KINDS) + kind) << BITS) + number
    cell, count = np.unique(cell, return_counts=True)
    group = cell >> BITS
    total = np.bincount(group, weights=count, minlength=n * len(_KINDS))
    value = np.sqrt(count / total[group])
    owner = np.concatenate([np.arange(n), group // len(_KINDS)])
    number = np.concatenate([np.zeros(n, np.int64), (cell & ((1 << BITS) - 1)) + 1])
    value = np.concatenate([np.ones(n), value])
    order = np.argsort(owner, kind="stable")
    return owner[order], number[order].astype(np.int32), value[order].astype(np.float32)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word with runs of capitals, other letters, digits and equal signs drawn together."""
    kind = data.copy()
    kind[((data >= 97) & (data <= 122)) | (data >= 128)] = 97
    kind[(data >= 65) & (data <= 90)] = 65
    kind[(data >= 48) & (data <= 57)] = 48
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(kind[keep], at[starts], at[ends])


@dataclass
class QualityModel:
    weights: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        owner, number, value = features(data, offsets)
        z = np.bincount(owner, weights=self.weights[number] * value, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class _Leader:
    """Per-coordinate steps with shrinkage."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        size = (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Fits on at most ``sample_rows`` labelled rows, chosen by the hash of their id.

    Labels are 0 or 1; rows with others or without an id are not used, repeated
    ones count each.  Without any the model knows nothing and scores 0.5.  The
    features of the sample are made where the texts are; one task, whose input
    is bounded by ``sample_rows`` documents, fits the weights.
    """
    usable = labels.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter("doc_id is not null and label in (0, 1)")
    n = usable.count()
    share = min(1.0, sample_rows / max(n, 1))
    # Bounded by sample_rows, so it may be broadcast.
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample_rows)
    sample = documents_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            owner, number, value = features(data, offsets)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("label"),
                    pa.array([number[a:b].tobytes() for a, b in pairs], pa.binary()),
                    pa.array([value[a:b].tobytes() for a, b in pairs], pa.binary()),
                ],
                ["doc_id", "label", "numbers", "vals"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "label", "numbers", "vals"))
            rows += zip(*columns, strict=True)
        rows.sort()  # the same steps whatever order the rows came in
        leader, rng = _Leader(), np.random.default_rng(11)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                _, label, number, value = rows[k]
                leader.learn(np.frombuffer(number, np.int32), np.frombuffer(value, np.float32), label)
        weights = leader.weights().astype(np.float32)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})

    cells = sample.select("doc_id", "label", "text").mapInArrow(cut, "doc_id long, label int, numbers binary, vals binary")
    fitted = cells.repartition(1).mapInArrow(fit, "weights binary").first()
    return QualityModel(np.frombuffer(fitted["weights"], np.float32))


def score_quality(
    docs: DataFrame,
    model: QualityModel,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text, beside ``columns``.

    ``columns`` is the id alone unless given; columns of the names added are
    replaced.  A null text counts as empty, and an empty one gets the score of the
    model's constant; every row yields one row.
    """
    columns = [c for c in columns or [id_col] if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # of fixed size
    text = "_text"
    while text in columns:
        text += "_"
    rows = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(shared.value)
        for batch in slices(batches, text):
            found = own.score(*text_bytes(batch.column(text)))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*columns, "score"])

    scored = rows.mapInArrow(score, rows.drop(text).withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
