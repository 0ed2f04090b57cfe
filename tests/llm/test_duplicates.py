"""Near-duplicate documents and lines against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.llm import line_dups, near_dups
from aftershock.llm.components import components
from aftershock.llm.line_dups import drop_repeated_lines
from aftershock.llm.near_dups import near_duplicates


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(docs, size):
    """Size and smallest reachable id by position."""
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(docs[i][0], len(sets[i]), least.get(find(i))) for i in range(len(docs))]


def found(df, **more):
    rows = near_duplicates(df, **more).collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def copies(seed, n, words, change):
    """Copies of one text, each with a share of its words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        rate = change * k / n
        out.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in base))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_odd_documents(odd_docs, no_docs, size):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs, words=size) == sorted(groups(docs, size), key=str)
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize(
    "levels, small, large, block",
    [(near_dups.LEVELS, 32, 2048, 256), (((4, 24), (8, 64)), 2, 1 << 20, 8), (((4, 24), (8, 64), (12, 164)), 2, 8, 8)],
)
def test_dense_groups(spark, monkeypatch, levels, small, large, block):
    """Pair by pair, in blocks, and with longer prefixes: the same groups."""
    for name, value in (("LEVELS", levels), ("SMALL", small), ("LARGE", large), ("BLOCK", block)):
        monkeypatch.setattr(near_dups, name, value)
    texts = copies(1, 60, 80, 0.25) + copies(2, 40, 200, 0.1) + copies(3, 20, 12, 0.2)
    docs = list(enumerate(texts, 10))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(df, words=4) == sorted(groups(docs, 4), key=str)


@pytest.mark.parametrize("level", range(len(near_dups.LEVELS)))
def test_borderline_pairs_meet_in_some_order(level):
    """Of 20,000 pairs whose signatures agree in four fifths of their positions, none to two are missed."""
    orders = near_dups._orders(level)
    assert orders.shape == near_dups.LEVELS[level][::-1] and len(np.unique(orders)) == orders.size
    rng = np.random.default_rng(level)
    missed = 0
    for _ in range(20):
        agree = rng.random((1000, orders.max() + 1)) < 0.8
        missed += int((~agree[:, orders].all(axis=2).any(axis=1)).sum())
    assert missed <= 2


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_take_for_equal(spark, n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{word} one two three"), (2, f"{other} one two three"), (3, word), (4, other), (5, f"{word} one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, words=4) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_sets_of_documents_without_id_are_fetched_once(spark):
    """As many rows for ``n`` documents of one id, or without any, as there are documents."""
    for doc_id in (None, 7):
        docs = [(doc_id, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(40)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        plain = near_dups.documents_of(df, "doc_id", "text")
        rows = near_dups.store(near_dups.shingle_signatures(plain, 4), "signatures").withColumnRenamed("row", "node")
        sets = near_dups._Sets(plain, rows, 4)
        seen, join = [], near_dups.join_measured

        def counted(*a, **b):
            joined = join(*a, **b)
            seen.append(joined.count())
            return joined

        near_dups.join_measured = counted
        try:
            assert sets.of(rows.select("node")).count() == 40
        finally:
            near_dups.join_measured = join
        assert seen == [40]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (101, 100)], "a long, b long")
    comps = {r["node"]: r["comp"] for r in components(links).collect()}
    assert comps == {**{i: 100 for i in range(100, 161)}, 5: 5, **{i: 5 for i in range(200, 260)}}


def line_words(line):
    return frozenset(w for w in re.split(r"[\x09-\x0D ]+", line.lower()) if w)


def expected_lines(docs):
    """Texts without repeated lines, by comparing every line with every earlier one."""
    lines = []
    for doc_id, text in docs:
        for no, line in enumerate(text.split("\n") if text is not None else []):
            if line_words(line):
                lines.append(((-(1 << 63) if doc_id is None else doc_id, no), line_words(line)))
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((doc_id, None, 0))
            continue
        keep, dropped = [], 0
        for no, line in enumerate(text.split("\n")):
            at, own = (-(1 << 63) if doc_id is None else doc_id, no), line_words(line)
            hit = bool(own) and any(
                b < at and 100 * len(own & u) >= 80 * len(own | u) for b, u in lines
            )
            dropped += hit
            if not hit:
                keep.append(line)
        out.append((doc_id, "\n".join(keep), dropped))
    return sorted(out, key=str)


def dropped(df):
    return sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in drop_repeated_lines(df).collect()), key=str)


def test_lines_of_odd_documents(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert dropped(odd_docs) == expected_lines(docs)
    assert drop_repeated_lines(odd_docs).columns == [*odd_docs.columns, "removed_lines"]
    assert drop_repeated_lines(no_docs).count() == 0


def test_similar_lines(spark):
    rng = random.Random(4)
    lines = copies(7, 60, 30, 0.3) + copies(8, 30, 8, 0.2) + ["a b c d", "a b c d"]
    lines += [" ".join(rng.sample(lines[3].split(), 30)), "  ".join(lines[65].split()).upper()]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    docs += [(None, lines[5]), (3, docs[3][1]), (500, lines[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert dropped(df) == expected_lines(docs)


def test_short_lines(spark):
    """Lines of any number of words count; four words are like five that hold them."""
    texts = ["Les.\n\nA b c d", "x y\nles.\n \n", "e a b c d\nY x x\nx y z", "a b c\nb A c\nx"]
    docs = list(enumerate(texts)) + [(9, "d c b a\nx y z w\nw z"), (10, "x z y\nz w")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert dropped(df) == expected_lines(docs)
    assert sum(r[2] for r in dropped(df)) == 7


def test_short_lines_of_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert dropped(docs) == expected_lines(rows)


def test_lines_alike_by_one_word(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "c b"), (4, "a c d")], "doc_id long, text string")
    found = {r["doc_id"]: r["removed_lines"] for r in drop_repeated_lines(docs, percent=50).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 0}


def test_long_different_lines_do_not_meet(spark, monkeypatch):
    """Lines of 200 words that share some rare ones; marks of so many words fill a map of 128 bits."""
    rng = random.Random(11)
    docs = []
    for i in range(60):
        rare = [f"r{rng.randrange(40)}" for _ in range(8)]
        docs.append((i, " ".join(rare + [f"c{rng.randrange(600)}" for _ in range(230)])))
    docs += [(100 + i, text + " more") for i, text in docs[:5]]
    made, plain = [], line_dups._pairs

    def counted(met, shared):
        made.append(met.count())
        return plain(met, shared)

    monkeypatch.setattr(line_dups, "_pairs", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert dropped(df) == expected_lines(docs)
    assert sum(r[2] for r in dropped(df)) == 5
    assert sum(made[:2]) < 400


def test_texts_are_moved_once(spark, monkeypatch):
    """Lines that are copies, done or wanted are told by bits; only the last join brings texts to their lines."""
    rows = [(i, f"one two three four w{i} five six seven eight nine\nthe line number {i % 5} comes again and again here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, line_dups.drop_repeated_lines(docs).collect()))
    assert {r[0]: r[2] for r in expected}[0] == 0 and sum(r[2] for r in expected) > 35
    moved, join = [], line_dups.join_measured

    def counted(left, right, on, how="inner"):
        moved.append(left.columns)
        return join(left, right, on, how)

    monkeypatch.setattr(line_dups, "join_measured", counted)
    monkeypatch.setattr(line_dups, "FEW_BYTES", 0)  # as for tables too large to be sent
    for most in (line_dups.MARK_BYTES, 0):
        monkeypatch.setattr(line_dups, "MARK_BYTES", most, raising=False)
        assert sorted(map(tuple, line_dups.drop_repeated_lines(docs).collect())) == expected
    assert moved == [docs.columns] * 2


def test_numbers_with_and_without_a_mark(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (1 << 33) - 1, 1 << 33, (5 << 33) + 12345, 1 << 62]
    marked = spark.createDataFrame([(n,) for n in numbers], "row long")
    around = sorted({n + d for n in numbers for d in (-1, 0, 1, 8)} - {-1})
    rows = spark.createDataFrame([(n,) for n in around], "row long")
    told = line_dups._with_mark(rows, F.col("row"), line_dups._marks(marked.unionByName(marked), F.col("row")))
    assert {r["row"] for r in told.filter("_marked").collect()} == set(numbers) and told.count() == len(around)


@pytest.mark.parametrize("percent", [67, 80, 90])
def test_borderline_lines_share_a_key(spark, percent):
    """As many words missing and added as the threshold allows, anywhere in the order of words; each pair is found."""
    rng = random.Random(percent)
    docs = []
    for k in range(150):
        n = rng.randint(4, 60)
        words = [f"p{k}w{i}" for i in range(n)] if k % 2 else [f"w{i}" for i in rng.sample(range(10**6), n)]
        a = rng.randint(0, (100 - percent) * n // 100)
        b = ((100 - percent) * n - 100 * a) // percent
        other = rng.sample(words, n - a) + [f"q{k}w{i}" for i in range(b)]
        rng.shuffle(words)
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    removed = {r["doc_id"]: r["removed_lines"] for r in drop_repeated_lines(df, percent=percent).collect()}
    assert removed == {i: i % 2 for i, _ in docs}


def test_few_keys_of_different_lines_are_left(spark, monkeypatch):
    """Lines of words that others have too, but not beside each other in the order of words."""
    rng = random.Random(12)
    docs = [(i, " ".join(f"w{x}" for x in rng.sample(range(3000), 20))) for i in range(400)]
    docs += [(500 + i, text + " more") for i, text in docs[:5]]
    stored, plain = {}, line_dups.store

    def kept(df, name):
        stored[name] = plain(df, name)
        return stored[name]

    monkeypatch.setattr(line_dups, "store", kept)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert dropped(df) == expected_lines(docs)
    # Nine keys a line; those of the five and of few others.
    assert 10 <= stored["posts"].count() < 400
