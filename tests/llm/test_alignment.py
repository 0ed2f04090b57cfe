"""Alignment of two tokenizers against a plain loop over the libraries' tokens."""

import hashlib
from bisect import bisect_left
from collections import Counter

import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aftershock.llm.alignment import align_tokens
from aftershock.llm.queries import op11_alignment

A_FILE, B_FILE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    # Its own rule: bytes that are no visible character are moved up in order.
    moved = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    table = {chr(b): b for b in range(256) if b not in moved} | {chr(256 + i): b for i, b in enumerate(moved)}
    return a, table, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def tokens(tools, text):
    """Pairs of id and bytes of both sides; none if they do not give the text back."""
    a, table, b = tools
    if not text:
        return [], []
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(table[c] for c in t)) for i, t in zip(left.ids, left.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(t for _, t in side) != want for side in (left, right)):
        return [], []
    return left, right


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(tools, texts):
    each, counts = [], Counter()
    for text in texts:
        left, right = map(spans, tokens(tools, text))
        links, j = [], 0
        for x, y, i in left:
            while j and right[j - 1][1] > x:
                j -= 1
            while j < len(right) and right[j][0] < y:
                if right[j][1] > x:
                    links.append((i, right[j][2]))
                j += 1
        counts.update(links)
        ends = sorted({y for _, y, _ in left} & {y for _, y, _ in right})
        groups = [([], []) for _ in ends]
        for k, side in enumerate((left, right)):
            for _, y, i in side:
                groups[bisect_left(ends, y)][k].append(str(i))
        groups = ["|".join([",".join(x), ",".join(y)]) for x, y in groups]
        each.append((left, right, links, groups))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (
            len(left), len(right), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), ";".join(groups),
        )
        for left, right, links, groups in each
    ]


TEXTS = [
    "The cat sat on the mat, and looked at the moon.",
    "The cat sat on the mat, and looked at the moon!  Twice.",
    "naïve café – 日本語 🙂 <|endoftext|> <s> x\x00y\r\nz ﬁ á  　",
    "a piece ▁ mark", None, "", " ", "\n\n\n", "   indented\n\tcode = {'k': 0x1F}", "<0x41><0x0A></s><unk>", "x" * 3000,
    "ornd edti oner lemquat brisoft " * 40, "﻿mark", "Les. " * 90, "1234567890 12345 007", "word " * 30000,
    "퟿ private", "é̂ ｆｕｌｌ ① ½",
]


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_matches_the_plain_loop(spark, tools, monkeypatch, hot):
    monkeypatch.setattr("aftershock.llm.alignment.HOT_PAIRS", hot)
    monkeypatch.setattr("aftershock.llm.alignment._HELD", 50)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit(0) for c in ("key", "pair", "same", "odd", "times", "n", "n_a", "groups", "_sum")})
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokens(df, A_FILE, B_FILE).collect()}
    expected = brute(tools, TEXTS)
    for i, row in enumerate(expected):
        assert got[i] == row, (i, got[i][:6], row[:6])
    assert len(got) == len(TEXTS) and expected[3][0] == 0 < expected[2][0]


def test_odd_documents(spark, tools, odd_docs, no_docs):
    texts = [r["text"] for r in odd_docs.select("text").collect()]
    got = Counter(tuple(r)[1:] for r in align_tokens(odd_docs, A_FILE, B_FILE).collect())
    assert got == Counter(brute(tools, texts))
    assert align_tokens(no_docs, A_FILE, B_FILE).count() == 0


def test_query_matches_the_plain_loop(spark, tools, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    expected = {}
    for r, row in zip(docs, brute(tools, [r["text"] for r in docs]), strict=True):
        expected[r["doc_id"]] = (*row[:6], hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_alignment(spark, sf).collect()}
    assert got == expected
