"""Pieces, token files, token counts: against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from public_tokenizers import path

from aftershock.llm.pieces import PieceModel, decode_pieces, encode_pieces
from aftershock.llm.token_counts import PART_CHARS, _Counter, count_tokens
from aftershock.llm.token_files import TokenFile, _disk, read_token_files, write_token_files
from aftershock.llm.tokens import ByteTokenizer, encode_documents
from aftershock.llm.words import span_hashes
from aftershock.session import new_path

MODEL, BPE = path("piece_bpe_32k.model"), path("byte_bpe_50k.json")


def texts_of(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


PARTS = [*"ab Zé'st\n\t ,.!?1²_-ßЖя́βﬁ日🙂\xa0\r<|>▁", "  ", "\n\n", "'s", " the", "ing", "def f(x):", "<|endoftext|>", "<s>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(BPE)


def test_pieces_equal_the_library_on_random_texts(library):
    texts = texts_of(1, 20_000, PARTS) + [" " * k + "x" + " " * (40 - k) for k in range(41)]
    ids, at = PieceModel.at(MODEL).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)


def test_decoding_gives_texts_back(library):
    model = PieceModel.at(MODEL)
    texts = texts_of(2, 2000, [p for p in PARTS if "▁" not in p])
    ids, offsets = model.encode(texts)
    assert model.decode(ids.astype(np.int64), offsets) == texts
    assert model.decode(np.array([3 + 0xE2, 3 + 0x82]), np.array([0, 2])) == ["\ufffd"]


def test_pieces_of_odd_rows(spark, odd_docs, no_docs, library):
    rows = decode_pieces(encode_pieces(odd_docs, MODEL), MODEL).collect()
    assert len(rows) == odd_docs.count()
    both = encode_pieces(odd_docs, MODEL, decoded=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, rows))
    for r in rows:
        assert r["ids"] == library.encode(r["text"])
        assert r["decoded"] == r["text"].replace("▁", " ")
    assert encode_pieces(no_docs, MODEL).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in decode_pieces(nulls, MODEL).collect()] == [None, ""]


def test_unigram_search_maximises_the_score():
    model = PieceModel.at(MODEL)
    model = object.__new__(PieceModel)
    model.bpe, model.size, model.other, model.longest = False, 4, 4, 2
    words = ["a", "b", "ab", "ba"]
    model.gain = np.array([-1.0, -1.5, -2.0, -3.0, -20.0])
    model.by_length = []
    for m in (1, 2):
        nodes = np.array([i for i, w in enumerate(words) if len(w) == m])
        codes = np.array([[ord(c) for c in words[i]] for i in nodes])
        h = PieceModel._prefix_hashes(codes)[:, -1]
        order = np.argsort(h)
        maybe = np.ones(1 << 18, bool)
        model.by_length.append((h[order], nodes[order], codes[order], maybe))
    node, back = model._search(np.array([[ord(c) for c in "aba"]]))
    assert node[0, 2] == 2 and back[0, 2] == 2  # "ab" beats "a" + "b"
    assert node[0, 3] == 0 and back[0, 3] == 1  # then "a"


def test_byte_tokenizer_equals_the_library(bpe):
    texts = texts_of(3, 30_000, PARTS)
    flat, at = ByteTokenizer.at(BPE).encode(pa.array(texts))
    found = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [e.ids for e in bpe.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n):
    """A word and its complement, whose polynomial hashes modulo powers of two are equal for every odd base."""
    flip = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < n:
        word += word.translate(flip)
    return word, word.translate(flip)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_take_for_equal(n, library, bpe):
    texts = [*thue_morse(n), " ".join(thue_morse(n)[::-1]), "x " + thue_morse(n)[1]]
    flat, at = ByteTokenizer(BPE).encode(pa.array(texts))
    found = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [e.ids for e in bpe.encode_batch(texts, add_special_tokens=False)]
    flat, at = PieceModel(MODEL).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)


def test_words_of_equal_hashes_keep_their_own_ids(monkeypatch, library, bpe):
    """All words of one length get the same hash, in one batch and over several."""
    monkeypatch.setattr("aftershock.llm.words.SHORT", 0)
    monkeypatch.setattr("aftershock.llm.words.span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = texts_of(8, 300, PARTS)
    byte, piece = ByteTokenizer(BPE), PieceModel(MODEL)
    for part in (texts[:100], texts[100:], texts):
        flat, at = byte.encode(pa.array(part))
        found = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert found == [e.ids for e in bpe.encode_batch(part, add_special_tokens=False)]
        flat, at = piece.encode(part)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(part)


def test_hashes_of_short_spans_differ():
    """Equal bytes have equal hashes wherever they stand, with zero bytes and at the end of the data."""
    data = np.frombuffer(b"ab\x00ab\x00\x00abcdefgabcdefghabcdefgabcdefgh\x00", np.uint8)
    starts = np.array([0, 3, 7, 14, 22, 29, 37])
    ends = np.array([3, 7, 14, 22, 29, 37, 38])
    h = span_hashes(data, starts, ends)
    assert h[2] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 5


def test_plain_special_strings(bpe):
    own = tokenizers.Tokenizer.from_file(BPE)
    own.encode_special_tokens = True
    texts = ["a<|endoftext|> b", "<|endoftext|>", *texts_of(5, 200, PARTS)]
    flat, at = ByteTokenizer(BPE, plain=True).encode(pa.array(texts))
    found = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_encoded_documents(odd_docs, no_docs, bpe):
    rows = encode_documents(odd_docs, BPE, end_id=9).collect()
    expected = sorted(bpe.encode(r["text"] or "", add_special_tokens=False).ids + [9] for r in odd_docs.collect())
    assert sorted(np.frombuffer(r["ids"], f"<u{r['width']}").tolist() for r in rows) == expected
    assert len({r["key"] for r in rows}) == len(rows)
    assert encode_documents(no_docs, BPE, end_id=9).count() == 0


def test_token_files_round_trip(spark, odd_docs, bpe):
    folder = new_path(spark, "test-files")
    write_token_files(odd_docs, folder, BPE, end_id=2, parts=3)
    rows = read_token_files(spark, folder).collect()
    rows.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(r["doc_id"] for r in odd_docs.collect() if r["doc_id"] is not None)
    expected = sorted(bpe.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in odd_docs.collect())
    assert sorted(r["ids"] for r in rows) == expected
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    some = read_token_files(spark, folder, doc_ids=[6, 7]).collect()
    assert sorted(r["doc_id"] for r in some) == [6, 7, 7, 7]


def test_token_files_frames(spark, odd_docs):
    import zstandard

    folder = new_path(spark, "test-files")
    files = write_token_files(odd_docs, folder, BPE, end_id=2, parts=1).collect()
    disk, top = _disk(folder)
    name = f"{top}/{files[0]['file']}"
    file = TokenFile(disk, name)
    # Any decoder can unpack the file; a reader of one document touches its frames only.
    raw = zstandard.ZstdDecompressor().stream_reader(open(name, "rb"), read_across_frames=True).read()
    assert raw == b"".join(file.ids(k).tobytes() for k in range(len(file.doc_ids)))
    damaged = bytearray(open(name, "rb").read())
    damaged[10] ^= 0xFF
    with open(f"{name}.bad", "wb") as f:
        f.write(damaged)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFile(disk, f"{name}.bad").ids(0)


def test_token_files_of_no_documents(spark, no_docs):
    folder = new_path(spark, "test-files")
    assert write_token_files(no_docs, folder, BPE, end_id=2).count() == 0
    assert read_token_files(spark, folder).count() == 0


def test_counts(odd_docs, no_docs, library, bpe):
    for r, limit in ((MODEL, 4), (BPE, 4)):
        rows = count_tokens(odd_docs, r, limit).collect()
        count = (lambda t: len(library.encode(t))) if r == MODEL else (lambda t: len(bpe.encode(t, add_special_tokens=False).ids))
        expected = sorted((len((d["text"] or "").encode()), count(d["text"] or "")) for d in odd_docs.collect())
        assert sorted((x["n_bytes"], x["n_tokens"]) for x in rows) == expected
        assert all(x["over_limit"] == (x["n_tokens"] > limit) for x in rows)
        assert count_tokens(no_docs, r, limit).count() == 0


def test_long_texts_are_counted_in_parts(library):
    rng = random.Random(5)
    text = "".join(rng.choice([" ", "  ", " the", "ab", "\n", " \n", "▁", " ▁", "x"]) for _ in range(120_000))
    parts = _Counter(MODEL).split(text)
    assert len(parts) > 2 and max(map(len, parts)) < 2 * PART_CHARS
    assert sum(len(library.encode(p)) for p in parts) == len(library.encode(text))
