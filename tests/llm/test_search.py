"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.llm import tiles
from aftershock.llm.neighbour_tree import Tree, nearest_found, recall
from aftershock.llm.tiles import vectors_of
from aftershock.llm.top_products import _products, top_products


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]),
        (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]),
        (100, [1.0, 1.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [5.0, 5.0]), (12, [-1.0, -2.0]), (-50, [3.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("uid", "tile", "leaf", "dim", "vec", "score")})


def brute(vectors, k, score):
    out = set()
    for q, x in vectors:
        if q % 50:
            continue
        found = sorted((-score(x, y), i) for i, y in vectors if i != q and len(y) == len(x))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)}
    return out


def rows_of(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def kept(spark, df):
    return [(r["vec_id"], r["vec"]) for r in vectors_of(df, "vec_id", "embedding").collect()]


def test_rows_that_take_part(spark):
    assert {i for i, _ in kept(spark, odd_vectors(spark))} == {0, 50, 7, 8, 9, 6, 100, 11, 12, -50}


@pytest.mark.parametrize("tile", [16, 64, 1 << 21])
def test_products_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr("aftershock.llm.top_products.TILE_BYTES", tile)
    monkeypatch.setattr("aftershock.llm.top_products._QUERY_BYTES", tile)
    df = odd_vectors(spark)
    rows = vectors_of(df, "vec_id", "embedding")
    found = top_products(rows.filter("vec_id % 50 = 0"), rows, 3)
    assert rows_of(found) == brute(kept(spark, df), 3, lambda x, y: int(np.dot(x, y)))


def test_products_of_large_numbers_are_exact():
    q, s = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0], [2.0**20, 2.0]])
    assert _products(q, s).tolist() == [[2**63 - 1, 2**60 + 2]]


def test_repeated_rows_and_queries_count_one_by_one(spark):
    rows = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, vec array<double>")
    found = top_products(rows.filter("vec_id = 0"), rows, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 1)] * 2 + [(0, 2, 1)] * 2


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "vec_id long, vec array<double>")
    assert top_products(rows, rows, 3).count() == 0
    assert nearest_found(rows, rows, 3).count() == 0


def test_few_vectors_are_all_found(spark):
    df = odd_vectors(spark)
    rows = vectors_of(df, "vec_id", "embedding")
    found = nearest_found(rows.filter("vec_id % 50 = 0"), rows, 3)
    vectors = [(i, np.array(v)) for i, v in kept(spark, df) if any(v)]
    expected = brute(vectors, 3, lambda x, y: round(float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())), 12))
    assert {(q, r, i, round(s, 12)) for q, r, i, s in rows_of(found)} == expected


def test_recall_on_many_vectors(spark, sf):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vec array<double>")
    queries = rows.filter("vec_id % 50 = 0")
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    near = unit[::50] @ unit.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    exact = spark.createDataFrame([(50 * q, int(i)) for q, r in enumerate(best) for i in r], "query_id long, vec_id long")
    assert recall(nearest_found(queries, rows, 5), exact) >= 0.9


def test_small_leaves_do_not_shorten_results(spark, monkeypatch):
    """Leaves of up to three rows, of which one is visited at first: still five rows for each query."""
    monkeypatch.setattr("aftershock.llm.neighbour_tree.LEAF_ROWS", 3)
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))]
    vectors += [(50, vectors[50][1])] * 9  # its own leaf holds nothing else
    rows = spark.createDataFrame(vectors, "vec_id long, vec array<double>")
    found = nearest_found(rows.filter("vec_id % 50 = 0"), rows, 5, target=0.1).collect()
    ranks = {}
    for r in found:
        assert r["vec_id"] != r["query_id"]
        ranks.setdefault(r["uid"], []).append(r["rank"])
    assert len(ranks) == 13 and all(sorted(r) == [1, 2, 3, 4, 5] for r in ranks.values())
    few = rows.filter("vec_id < 3")
    assert nearest_found(few.filter("vec_id = 0"), few, 5).count() == 2


def test_rows_of_the_own_id_do_not_displace_equal_vectors():
    ids, data = tiles.enough_copies(np.array([7, 7, 7, 7, 8, 9, 10]), np.ones((7, 2)), 2)
    assert ids.tolist() == [7, 7, 8, 9]


def test_a_walk_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3000, 8))
    tree = Tree.fit(data)
    assert tree.leaves > 8
    walk = tree.visits(data[:20], tree.leaves)
    assert (np.sort(walk, axis=1) == np.arange(tree.leaves)).all()
    # Equal vectors give one leaf, and a tree of nothing else has a single one.
    assert Tree.fit(np.ones((500, 4))).leaves == 1


def test_of_equal_vectors_the_smallest_ids_stay():
    ids, data = tiles.enough_copies(np.arange(9, -1, -1), np.ones((10, 2)), 2)
    assert ids.tolist() == [0, 1, 2]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_of_products_do_not_pass_the_driver(spark, monkeypatch):
    """Copies of queries for all parts of the rows are shuffled, however small Spark takes them to be."""
    monkeypatch.setattr("aftershock.llm.top_products.TILE_BYTES", 16)
    monkeypatch.setattr("aftershock.llm.tiles.GROUP_BYTES", 32)
    df = odd_vectors(spark)
    rows = vectors_of(df, "vec_id", "embedding")
    found = top_products(rows.filter("vec_id % 50 = 0"), rows, 3)
    assert "Broadcast" not in plan_of(found)
    assert rows_of(found) == brute(kept(spark, df), 3, lambda x, y: int(np.dot(x, y)))


def test_narrowed_vectors_come_back_bit_by_bit():
    for data, width in (([[1, -32768]], 2), ([[0.5, 2.0**100]], 4), ([[-0.0, 1]], 4), ([[0.1, 1]], 8), ([[2.0**31 + 1]], 8)):
        small = tiles.narrowed(np.array(data, np.float64))
        assert small.itemsize == width
        back = tiles.unpack(np.arange(1).tobytes(), np.arange(1).tobytes(), small.tobytes(), small.shape[1])[2]
        assert back.tobytes() == np.array(data, np.float64).tobytes()


def test_lists_keep_the_best_rows_of_all_tiles():
    least = np.iinfo(np.int64).min
    lists = tiles.BestLists(3, 2, np.int64)
    lists.add(np.array([0, 0, 2]), np.array([9, 8, 1]), np.array([least, 5, 7]))
    assert lists.least(slice(0, 3)).tolist() == [least] * 3 and lists.count.tolist() == [2, 0, 1]
    lists.add(np.array([2, 0, 2, 0]), np.array([0, 3, 5, 8]), np.array([7, 5, 7, 5]))
    assert lists.ids[0].tolist() == [3, 8] and lists.ids[2].tolist() == [0, 1]
    assert lists.score[[0, 2]].tolist() == [[5, 5], [7, 7]] and lists.least(np.array([0])).tolist() == [5]


def test_candidates_below_the_last_kept_score_are_left_out():
    near = np.array([[3.0, 1.0, 2.0, 3.0], [0.0, 5.0, 4.0, 1.0]])
    exact = near.copy()
    at, ids, score = tiles.best_of_tile(
        near, lambda r, c: exact[r, c], np.array([7, 20]), np.array([9, 7, 8, 7]), 2, 0.0, np.array([3.0, -np.inf])
    )
    assert (at.tolist(), ids.tolist(), score.tolist()) == ([0, 1, 1], [9, 7, 8], [3.0, 5.0, 4.0])


def test_queries_of_the_tree_do_not_pass_the_driver(spark, monkeypatch):
    """Many leaves, parts and groups: queries are shuffled, and every leaf of a walk is read."""
    monkeypatch.setattr("aftershock.llm.neighbour_tree.LEAF_ROWS", 3)
    monkeypatch.setattr("aftershock.llm.neighbour_tree.TILE_BYTES", 64)
    monkeypatch.setattr("aftershock.llm.tiles.GROUP_BYTES", 64)
    rng = np.random.default_rng(6)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))] + [(301, [1.0, 2.0]), (350, [2.0, 2.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, vec array<double>").repartition(3)
    found = nearest_found(rows.filter("vec_id % 50 = 0"), rows, 3, target=1.0)
    assert "Broadcast" not in plan_of(found)
    vectors = [(i, np.array(v)) for i, v in vectors]
    expected = brute(vectors, 3, lambda x, y: float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())))
    got = {(q, r, i) for q, r, i, _ in rows_of(found)}
    expected = {x[:3] for x in expected}
    # All leaves that the sample's neighbours lie in are visited: near all true neighbours.
    assert len(got) == len(expected) and len(got & expected) >= 0.9 * len(expected)
