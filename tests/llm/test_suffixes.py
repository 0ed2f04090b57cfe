"""Repeated strings against brute force, and the merge of front-coded runs."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aftershock.llm import suffixes
from aftershock.llm.queries import op12_suffix_dups
from aftershock.llm.suffix_dedup import drop_repeated_strings


def brute(texts, span):
    """Removed spans and remaining bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i + 1 : i + 1 + span] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(b for b, g in zip(x, gone[1:], strict=False) if not g)
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), kept))
    return out


def check(spark, texts, span, parts=3):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    df = df.withColumns({c: F.lit(0) for c in ("uid", "th", "at", "part", "copies", "spans", "kept", "n")})
    got = {r["doc_id"]: r for r in drop_repeated_strings(df, span).collect()}
    assert len(got) == len(texts)
    for i, (spans, kept) in enumerate(brute(texts, span)):
        assert [(s["begin"], s["stop"]) for s in got[i]["removed"]] == spans, i
        assert bytes(got[i]["kept"]) == kept


def passages(seed, n, span):
    """Texts that share passages of many lengths, whole copies, periodic and short texts, and odd characters."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé日"), 4)) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(words, k))

    shared = [prose(int(k)) for k in rng.integers(span // 12, span, 6)]
    texts = []
    for _ in range(n):
        pieces = [prose(int(rng.integers(0, 30))) for _ in range(3)]
        for k in rng.integers(0, 6, 2):
            cut = shared[k]
            a, b = sorted(rng.integers(0, len(cut) + 1, 2))
            pieces.insert(1, cut if rng.random() < 0.5 else cut[a:b])
        texts.append("".join(pieces))
    texts += [texts[0], texts[0], None, "", None, "a" * (span - 1), "b" * span, "c" * (span + 1), "xy" * span]
    texts += [shared[0] + "\x00" * 3, shared[0] + "\x00" * 5, shared[1][5:], "\x00" * (span + 2)]
    return texts


@pytest.mark.parametrize(("span", "part", "run"), [(20, 1 << 15, 1 << 15), (41, 64, 16), (2, 256, 100), (400, 8, 64)])
def test_matches_brute_force(spark, monkeypatch, span, part, run):
    """Small parts split crowded hashes, small runs leave much to merge."""
    monkeypatch.setattr("aftershock.llm.suffix_dedup.PART_SUFFIXES", part)
    monkeypatch.setattr("aftershock.llm.suffix_dedup.RUN_SUFFIXES", run)
    texts = passages(span, 30, span)
    if span == 2:
        texts = [t and t[:40] for t in texts]
    check(spark, texts, span)


def test_one_passage_in_every_text(spark, monkeypatch):
    """Hundreds of different suffixes with one begin, in several parts."""
    monkeypatch.setattr("aftershock.llm.suffix_dedup.PART_SUFFIXES", 40)
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefgh "), 90))
    texts = []
    for i in range(150):
        own = "".join(rng.choice(list("abcdefgh "), 60))
        a, b = sorted(rng.integers(0, 30, 2))
        texts.append(own[:30] + passage[a : 60 + b] + own[30:])
    check(spark, texts, 50)


def test_odd_documents(spark, odd_docs, no_docs):
    got = drop_repeated_strings(odd_docs, 20).collect()
    rows = odd_docs.collect()
    expected = Counter((r["doc_id"], kept) for r, (_, kept) in zip(rows, brute([r["text"] for r in rows], 20), strict=True))
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in got) == expected
    assert drop_repeated_strings(no_docs, 20).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_strings(no_docs, 1)


def test_query_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnop ")
    shared = "".join(rng.choice(letters, 900))
    texts = ["".join(rng.choice(letters, 300)) + shared[a : a + n] for a, n in ((0, 900), (100, 399), (200, 400), (3, 800))]
    texts += [None, "", shared[250:700]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_suffix_dups(spark, str(tmp_path)).collect()))
    expected = []
    for i, (spans, kept) in enumerate(brute(texts, 400)):
        n = len((texts[i] or "").encode())
        expected.append((i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert got == expected and sum(r[2] for r in got) > 2000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=5, max_size=5).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=6))
def test_merge_of_front_coded_runs(runs):
    coded = []
    for run in runs:
        keys = np.array([list(x) for x in sorted(run)], np.uint8).reshape(-1, 5)
        coded.append(suffixes.front_coded(keys))
    got = list(suffixes.merged(coded, 5))
    rows = [row for _, row, _ in got]
    assert rows == sorted(x for run in runs for x in run)
    for i, (run, row, shared) in enumerate(got):
        assert row in runs[run]
        assert shared == (suffixes.common(rows[i - 1], row, 0) if i else 0)


@pytest.mark.parametrize("held", [1 << 20, 64])
def test_anchors_cover_all_strings(monkeypatch, held):
    monkeypatch.setattr(suffixes, "_HELD", held)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (500, 0, 7, 30, 29)] + [b"z" * 90]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, place, low, high, seed = suffixes.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, 30)
    begins = sorted((t, p - d) for t, p, a, b in zip(text, place, low, high, strict=True) for d in range(a, b + 1))
    assert begins == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 29)]
    by_hash = {}
    for t, p, s in zip(text, place, seed, strict=True):
        assert by_hash.setdefault(s, texts[t][p : p + 15]) == texts[t][p : p + 15]
