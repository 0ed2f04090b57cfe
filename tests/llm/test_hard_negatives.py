"""Hard negatives against brute force, and the bounds that filter candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.llm.hard_negatives import code, hard_negatives, intervals
from aftershock.llm.queries import op13_hard_negatives


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    out = []
    for a, label, x in anchors:
        scored = [
            (-int(np.dot(x, y)), i, other) for i, other, y in rows if i != a and len(y) == len(x)
        ]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            hard = sorted(
                r for r in scored if r[2] != label and -low * s <= -100 * r[0] <= -high * s
            )
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<double>").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("uid", "tile", "rank", "least", "score", "bucket")})


def found(anchors, rows, **options):
    return sorted(map(tuple, hard_negatives(anchors, rows, **options).collect()))


@pytest.mark.parametrize("tile", [64, 1 << 21])
def test_matches_brute_force(spark, monkeypatch, tile):
    """Ties, repeated rows and anchors, equal vectors, other dimensions, single labels, negative scores."""
    monkeypatch.setattr("aftershock.llm.tiles.TILE_BYTES", tile)
    monkeypatch.setattr("aftershock.llm.hard_negatives.TILE_BYTES", tile)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), rng.integers(-4, 9, 3).astype(float).tolist()) for i in range(150)]
    rows += [(i, i % 2, [5.0, 5.0, 5.0]) for i in range(200, 260)]
    rows += [(100, 1, [7.0, 1.0, 2.0])] * 2 + [(300, 9, [1.0, 1.0, 1.0]), (301, 1, [4.0, 4.0]), (302, 2, [3.0, 4.0])]
    rows += [(400, 1, [-6.0, 0.0, 0.0]), (401, 0, [0.0, 0.0, 0.0])]
    anchors = [r for r in rows if r[0] % 20 == 0]
    got = found(frame(spark, anchors), frame(spark, rows), positives=3, negatives=4)
    assert got == brute(rows, anchors, 3, 4)
    # Vectors so large that doubles cannot hold their products.
    big = [(i, l, [x * 2.0**26 for x in v]) for i, l, v in rows]
    expected = brute(big, big[:3], 2, 3)
    assert expected and found(frame(spark, big[:3]), frame(spark, big), positives=2, negatives=3) == expected


def test_empty_tables(spark):
    none = frame(spark, [(1, 1, [1.0])]).filter("vec_id < 0")
    some = frame(spark, [(1, 1, [1.0]), (2, 1, [1.0])])
    assert hard_negatives(none, none).count() == hard_negatives(none, some).count() == 0
    assert hard_negatives(some, some).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 64, 130])
def test_true_scores_lie_in_their_intervals(dim):
    rng = np.random.default_rng(dim)
    rows = np.floor(256 * rng.normal(size=(300, dim)))
    rows[:3] = [[0.0], [1.0], [-7.0]]
    queries = np.concatenate([rows[::40], rng.integers(-9, 9, (5, dim)).astype(float)])
    lower, upper = intervals(queries, *code(rows))
    exact = queries @ rows.T
    assert (lower <= exact).all() and (exact <= upper).all()
    if dim > 1:
        assert (upper - lower).mean() < 2 * np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)).mean()


def test_query_leaves_out_rows_without_label_or_vector(spark, tmp_path):
    nan = float("nan")
    rows = [(100, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.25, 0.25], 2), (3, [0.5, 0.5], None), (4, None, 2)]
    rows += [(5, [None, 0.5], 2), (6, [nan, 0.5], 2), (7, [0.25, 0.125], 1), (None, [0.5, 0.5], 2), (8, [], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    got = sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect()))
    # Row 7 gets label 2.
    assert got == [(100, 1, 1, 2, 24576, 16384), (100, 1, 2, 7, 24576, 12288)]


@pytest.mark.parametrize("group", [1, 200])
def test_anchors_do_not_pass_the_driver(spark, monkeypatch, group):
    """Copies of anchors for all parts of the rows are shuffled; parts have several tiles, groups several blocks."""
    monkeypatch.setattr("aftershock.llm.hard_negatives.TILE_BYTES", 64)
    monkeypatch.setattr("aftershock.llm.tiles.GROUP_BYTES", group)
    monkeypatch.setattr("aftershock.llm.tiles.LEAST_PARTS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.integers(-4, 9, 3).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, i % 2, [4.0, 1.0]) for i in range(6)]
    anchors = [r for r in rows if r[0] % 20 == 0]
    df = hard_negatives(frame(spark, anchors), frame(spark, rows), 3, 4)
    assert sorted(map(tuple, df.collect())) == brute(rows, anchors, 3, 4)
    # Of the last join only the positives, a stored table, may be sent to all tasks.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and not [x for x in plan.splitlines() if "Join" in x and "dim#" in x]
