"""Packing: every token once, no gaps, no padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import tokenizers
from public_tokenizers import path

from aftershock.llm.common import store
from aftershock.llm.packing import exact_patterns, pack_documents
from aftershock.llm.tokens import encode_documents

BPE = path("byte_bpe_50k.json")


def check(rows, docs, size):
    """``docs``: ids of the tokens of each document."""
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    whole = []
    for (doc_id, n), parts in pieces.items():
        parts.sort()
        repeated = sum(1 for p in parts if p[0] == 0)
        for start, length, crc, ids in parts:
            assert len(ids) == length and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sum(p[1] for p in parts) == n * repeated
        if repeated == 1:
            assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        whole += [(doc_id, n)] * repeated
    assert sorted(whole, key=str) == sorted(((d, len(i)) for d, i in docs), key=str)


@pytest.mark.parametrize("size", [16, 1024])
def test_odd_documents(odd_docs, no_docs, size):
    bpe = tokenizers.Tokenizer.from_file(BPE)
    docs = [(r["doc_id"], bpe.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()]
    rows = pack_documents(store(encode_documents(odd_docs, BPE, 0), "t"), size, with_ids=True).collect()
    check(rows, docs, size)
    by_doc = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        if r["doc_id"] in (1, 6, -50):
            by_doc[r["doc_id"]] += r["ids"]
    assert {d: i for d, i in docs if d in (1, 6, -50)} == by_doc
    assert pack_documents(store(encode_documents(no_docs, BPE, 0), "t"), size).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bpe = tokenizers.Tokenizer.from_file(BPE)
    expected = [(r["doc_id"], bpe.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    rows = pack_documents(store(encode_documents(docs, BPE, 0), "t"), 1024, with_ids=True).collect()
    check(rows, expected, 1024)
    # Most documents are cut no more often than their length demands.
    least = sum(-(-len(i) // 1024) for _, i in expected)
    assert len(rows) < 1.25 * least


def test_patterns_fill_sequences_within_the_supply():
    rng = np.random.default_rng(0)
    for top in (10, 400, 1024):
        lengths, n = np.unique(rng.integers(1, top, 60_000), return_counts=True)
        supply = dict(zip(lengths.tolist(), n.tolist(), strict=True))
        patterns = exact_patterns(supply, 1024)
        used = defaultdict(int)
        for times, counts in patterns:
            assert sum(r * k for r, k in counts.items()) == 1024
            for r, k in counts.items():
                used[r] += times * k
        assert all(used[r] <= supply[r] for r in used)
        assert sum(r * k for r, k in used.items()) > 0.9 * sum(r * k for r, k in supply.items())


def test_patterns_where_little_fits():
    assert exact_patterns({}, 1024) == []
    assert exact_patterns({700: 50}, 1024) == []
    assert exact_patterns({512: 5}, 1024) == [(2, {512: 2})]
