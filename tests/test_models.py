"""Neighbours against brute force, and the parts of a sweep."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aftershock.catalog import scans
from aftershock.operators import neighbours, reports, trees
from aftershock.plans.sweeps import (
    SweepSpec,
    bundle_table,
    feature_names,
    lattice_dataset,
    lattice_of,
    market_columns,
    sweep_dataset,
    sweep_plan,
)


@pytest.fixture(scope="module")
def points(spark):
    """300 points, a third of them the same spot."""
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(300, 3)) * [1, 5, 20]
    spots[::3] = [1.0, 2.0, 3.0]
    rows = [(i, [float(x) for x in p], int(i % 4), i % 3) for i, p in enumerate(spots)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int, fold int")
    return df, spots


@pytest.mark.parametrize(("pivots", "block_rows"), [(32, 16384), (4, 17), (1, 50)])
def test_nearest_is_exact(points, pivots, block_rows):
    df, spots = points
    test, train = df.filter("id % 5 = 0"), df.filter("id % 5 <> 0")
    found = neighbours.nearest(test, train, 7, ["label"], pivots=pivots, block_rows=block_rows)
    got = {(r["test_id"], r["rank"]): (r["train_id"], r["dist"]) for r in found.collect()}
    known = [i for i in range(300) if i % 5]
    for i in range(0, 300, 5):
        dist = [(round(float(np.sqrt(((spots[i] - spots[j]) ** 2).sum())), 6), j) for j in known]
        for rank, (d, j) in enumerate(sorted(dist)[:7], 1):
            assert got[i, rank] == (j, d)
    assert len(got) == 60 * 7


def test_nearest_leaves_out_the_own_fold(points):
    df, _ = points
    found = neighbours.nearest(df, df, 5, ["label"], fold="fold", pivots=6, block_rows=40)
    assert found.count() == 300 * 5
    assert found.filter("test_id % 3 = train_id % 3").isEmpty()


def _brute(test, train, k):
    out = []
    for i, x in test:
        dist = sorted((round(float(np.sqrt(((np.array(x) - y) ** 2).sum())), 6), j) for j, y in train)
        out += [(i, rank, j, d) for rank, (d, j) in enumerate(dist[:k], 1)]
    return sorted(out)


def test_nearest_with_few_rows_ties_and_other_keys(spark, monkeypatch):
    """Fewer rows than k, repeated vectors and test rows, text keys, parts of one row."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 1)
    train = [(f"t{i}", [float(i % 3), 1.0]) for i in range(7)]
    test = [("a", [0.0, 1.0]), ("b", [2.0, 1.0]), ("b", [2.0, 1.0]), ("far", [1e6, -1e6])]
    schema = "id string, vector array<double>"
    a, b = spark.createDataFrame(test, schema), spark.createDataFrame(train, schema)
    for k in (3, 9):
        found = neighbours.nearest(a, b, k, []).select("test_id", "rank", "train_id", "dist").collect()
        assert sorted(map(tuple, found)) == _brute(test, train, k)
    assert neighbours.nearest(a.limit(0), b, 3, []).count() == 0
    assert neighbours.nearest(a, b.limit(0), 3, []).count() == 0


def _searched(spark, n):
    """Test rows times blocks searched, and rows of blocks sent, for ``n`` clustered vectors."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 8)) * 20
    data = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>")
    sent, plain = [], neighbours._asked

    def counted(parts, cells, k, by_fold):
        asked = neighbours.stored(plain(parts, cells, k, by_fold), "asked")
        size = F.octet_length("row") / 4
        sizes = spark.createDataFrame(
            [(g, int(b), int(cells.rows[cells.group == g].sum() / b)) for g, b in enumerate(cells.blocks)],
            "group int, blocks int, rows int",
        )
        sent.append(asked.join(sizes, "group").agg(F.sum(size), F.sum("rows")).first())
        return asked

    neighbours._asked = counted
    try:
        test, train = rows.filter("id % 5 = 0"), rows.filter("id % 5 <> 0")
        found = neighbours.nearest(test, train, 5, [], block_rows=max(64, n // 100))
        assert found.count() == n
    finally:
        neighbours._asked = plain
    return sum(float(s[0] or 0) for s in sent), sum(float(s[1] or 0) for s in sent)


def test_rows_sent_grow_with_the_rows(spark):
    """Ten times the vectors, far less than a hundred times the rows sent."""
    few, many = _searched(spark, 5_000), _searched(spark, 50_000)
    assert many[0] < 15 * few[0] and many[1] < 30 * few[1]
    # All rows to all parts would be at least 40,000 rows for each of some hundred blocks.
    assert many[0] < 10 * 10_000


def test_only_the_best_rows_leave_a_search(spark, monkeypatch):
    """No table of candidates is written, and votes are dealt before there is a row for each k."""
    rng = np.random.default_rng(2)
    data = [(i, v.tolist(), int(i % 3), i % 5) for i, v in enumerate(rng.normal(size=(1500, 6)))]
    rows = spark.createDataFrame(data, "id long, vector array<double>, label int, fold int")
    kept, plain = {}, neighbours.stored

    def counted(df, name="table"):
        table = plain(df, name)
        kept[name] = max(kept.get(name, 0), table.count())
        return table

    monkeypatch.setattr(neighbours, "stored", counted)
    found = neighbours.nearest(rows, rows, 40, ["label"], fold="fold", block_rows=100)
    assert max(kept.values()) <= 1500
    assert found.count() == 1500 * 40
    votes = neighbours.knn_classify(found, "label", (1, 20, 40))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]


def test_blocks_of_many_rows_stay_small(spark, monkeypatch):
    """Blocks have their full size on small tables already, so a task's memory does not grow on to larger ones."""
    sizes, tiles = [], neighbours._tiles

    def counted(rows, place, keep):
        out = tiles(rows, place, keep)
        if "block" in place:
            sizes.extend(r[0] for r in out.selectExpr("length(fold) div 4").collect())
        return out

    monkeypatch.setattr(neighbours, "_tiles", counted)
    rows = spark.range(20000).selectExpr("id", "array(cast(id % 100 AS double), cast(id AS double)) AS vector", "id % 7 AS y")
    near = neighbours.nearest(rows.filter("id % 1000 = 0"), rows, 3, ["y"])
    assert near.filter("rank = 1 AND dist = 0 AND test_id = train_id AND y = test_id % 7").count() == 20
    assert sum(sizes) == 20000 and max(sizes) < 13000


def test_many_equal_rows_take_little_memory():
    """A block of one vector: all its rows are as near as the k-th."""
    known, x = np.ones((8192, 64)), np.zeros((256, 64))
    rest = pa.RecordBatch.from_arrays([pa.array(np.arange(8192)[::-1].copy())], ["train_id"])
    none = np.zeros(256, np.int32)
    best = neighbours._Best(5, False, x, none, pa.array(np.arange(256)), np.full(256, np.inf))
    tracemalloc.start()
    for _ in range(2):
        best.add(np.arange(256), known, np.zeros(8192, np.int32), rest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # all pairs of vectors: 1,074 MB
    rows = pa.Table.from_batches(best.found(["test_id", "rank", "dist", "train_id"])).to_pydict()
    assert rows["train_id"] == [0, 0, 1, 1, 2] * 256 and rows["rank"] == [1, 2, 3, 4, 5] * 256
    assert set(rows["dist"]) == {8.0}


def test_votes_and_means(spark):
    near = spark.createDataFrame(
        [(1, 1, 2, 10.0), (1, 2, 3, 20.0), (1, 3, 3, 60.0)], "test_id int, rank int, label int, pips double"
    )
    votes = {r["k"]: r["predicted"] for r in neighbours.knn_classify(near, "label", (1, 2, 3)).collect()}
    assert votes == {1: 2, 2: 2, 3: 3}
    means = {r["k"]: r["predicted"] for r in neighbours.knn_regress(near, "pips", (1, 2, 3)).collect()}
    assert means == {1: 10.0, 2: 15.0, 3: 30.0}


def test_reports(spark):
    scores = spark.createDataFrame(
        [("s", 0, 0)] * 6 + [("s", 0, 1)] * 2 + [("s", 1, 1)] * 1 + [("s", 1, 0)] * 3, "sweep_id string, y int, yhat int"
    )
    r = reports.classification_report(scores).first()
    assert (r["precision_above_TH"], r["recall_above_TH"]) == (round(1 / 3, 6), 0.25)
    assert (r["support_below_TH"], r["support_above_TH"], r["f1_microavg"]) == (8, 4, round(7 / 12, 6))
    never = reports.classification_report(scores.withColumn("yhat", F.lit(0))).first()
    assert never["precision_above_TH"] == 0.0


def test_shared_bundles_give_the_same_table(spark, sf):
    features = scans.scored_features(spark, sf).cache()
    for name in ("ALL_NO_3_2_1", "High_YES_1_1_1"):
        spec = SweepSpec(name, "all", "included", "30_60", "basic", "min")
        alone = sweep_dataset(features, spec)
        shared = sweep_dataset(features, spec, bundle_table(features, spec))
        assert sorted(map(str, alone.collect())) == sorted(map(str, shared.select(*alone.columns).collect()))
        assert spec.target not in feature_names(alone, spec)
        if spec.isolated:
            assert alone.filter("num_news <> 1").isEmpty()
    features.unpersist()


def test_the_lattice_gives_the_same_tables(spark, sf):
    features = scans.scored_features(spark, sf).cache()
    names = ("ALL_NO_3_2_1", "ALL_YES_1_1_1", "High_YES_1_1_1", "Low_NO_3_2_1")
    specs = [SweepSpec(n, "all", "excluded", "30_60", "basic", "min") for n in names]
    lattice = lattice_of(features, market_columns(specs[0])).cache()
    for spec in specs:
        plain = sweep_dataset(features, spec)
        found = lattice_dataset(lattice, spec)
        assert dict(found.dtypes) == dict(plain.dtypes)
        assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    plan = sweep_plan(None, lattice=lattice)
    assert sorted(map(str, plan.collect())) == sorted(map(str, sweep_plan(features).collect()))
    features.unpersist()
    lattice.unpersist()


def test_grid_points():
    assert trees.grid_points(a=(1, 2), b=(3,)) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_spec_parts():
    spec = SweepSpec("ALL_NO_3_2_1", horizon="30_60", direction="min")
    assert (spec.impact, spec.isolated, spec.weights, spec.minutes) == ("ALL", False, (3, 2, 1), (30, 60))
    assert spec.target == "pips_candle_min_30_60_after"
    assert spec.sweep_id == "ALL_NO_3_2_1-basic-included-30_60-basic-min"


@pytest.fixture(scope="module")
def grid_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=600) > 0).astype(int)
    z = x[:, 0] * 3 + x[:, 3] + rng.normal(size=600)
    rows = [(*map(float, r), int(a), float(b), i % 3) for i, (r, a, b) in enumerate(zip(x, y, z, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y int, z double, fold int").cache()


@pytest.mark.parametrize("name", ["rforest", "gboosting"])
@pytest.mark.parametrize(("kind", "target"), [("clf", "y"), ("reg", "z")])
def test_nodes_predict_as_the_model_does(spark, grid_rows, name, kind, target):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(grid_rows)
    more = {"rforest": {"numTrees": 6}, "gboosting": {"maxIter": 6}}[name]
    learner = trees._MODELS[name, kind](featuresCol="features", labelCol=target, seed=1, maxDepth=5, **more)
    model = learner.fit(rows)
    told = model.transform(rows).select(*"abcd", "prediction").toPandas()
    nodes = trees.Nodes.of(model, name, kind, spark)
    found = nodes.predictions(told[list("abcd")].to_numpy(), 5, [len(nodes.roots)])[0]
    assert np.allclose(found, told["prediction"].to_numpy())
    if name == "gboosting" and kind == "reg":  # fewer rounds are a part of the chain
        told = model.evaluateEachIteration(rows, "squared")
        x, y = grid_rows.toPandas()[list("abcd")].to_numpy(), grid_rows.toPandas()["z"].to_numpy()
        rounds = nodes.predictions(x, 5, range(1, 7))
        assert np.allclose([((r - y) ** 2).mean() for r in rounds], told)


def _plain_tree(x, y, edges, leaf, depth, kind):
    """A decision tree grown by trying every split; returns a function that predicts one row."""
    n, s = len(y), float(sum(y))
    value = float(2 * s > n) if kind == "clf" else s / n

    def spread(v):
        return 2 * v.sum() * (len(v) - v.sum()) / len(v) if kind == "clf" else (v * v).sum() - v.sum() ** 2 / len(v)

    best = None
    for f, cuts in enumerate(edges if depth else []):
        for cut in cuts:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < max(leaf, 1):
                continue
            gain = round(float(spread(y) - spread(y[left]) - spread(y[~left])) / n, 10)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, cut, left)
    if best is None:
        return lambda row: value
    _, f, cut, left = best
    small = _plain_tree(x[left], y[left], edges, leaf, depth - 1, kind)
    large = _plain_tree(x[~left], y[~left], edges, leaf, depth - 1, kind)
    return lambda row: small(row) if row[f] <= cut else large(row)


@pytest.mark.parametrize(("kind", "target"), [("clf", "y"), ("reg", "z")])
def test_levels_grow_the_trees_of_a_plain_search(grid_rows, kind, target):
    points = trees.grid_points(maxDepth=(1, 2, 4), minInstancesPerNode=(1, 25, 120))
    fitted = trees.fit_grid(grid_rows, list("abcd"), target, "dtree", kind, points, folds=3)
    told = grid_rows.toPandas()
    x, y, fold = told[list("abcd")].to_numpy(), told[target].to_numpy(float), told["fold"].to_numpy()
    edges = []
    for f in range(4):
        ranks = np.sort(x[:, f])
        cuts = np.unique([ranks[int(np.ceil(i / 32 * len(ranks))) - 1] for i in range(1, 32)])
        edges.append(cuts[cuts < ranks[-1]])
    for point, score in zip(points, fitted.scores, strict=True):
        each = []
        for held in range(3):
            on = fold != held
            tree = _plain_tree(x[on], y[on], edges, point["minInstancesPerNode"], point["maxDepth"], kind)
            guess = np.array([tree(r) for r in x[~on]])
            each.append((guess == y[~on]).mean() if kind == "clf" else np.sqrt(((guess - y[~on]) ** 2).mean()))
        assert abs(np.mean(each) - score) < 1e-9, point
    assert fitted.best == fitted.scores.index(max(fitted.scores) if kind == "clf" else min(fitted.scores))
    best = points[fitted.best]
    tree = _plain_tree(x, y, edges, best["minInstancesPerNode"], best["maxDepth"], kind)
    guess = fitted.predict(grid_rows).select("prediction").toPandas()["prediction"].to_numpy()
    assert np.allclose(guess, [tree(r) for r in x])


@pytest.mark.parametrize("name", ["dtree", "rforest"])
def test_rows_with_nulls_are_counted_and_come_back(grid_rows, name):
    holes = grid_rows.withColumn("b", F.when(F.col("a") > 1, None).otherwise(F.col("b")))
    lost = holes.filter("b IS NULL").count()
    points = trees.grid_points(maxDepth=(2,))
    fitted = trees.fit_grid(holes, list("abcd"), "y", name, "clf", points, folds=3)
    assert lost > 0 and (fitted.fitted_rows, fitted.left_out_rows) == (600 - lost, lost)
    scored = fitted.predict(holes)
    assert scored.count() == 600
    assert scored.filter("prediction IS NULL").count() == lost == scored.filter("prediction IS NULL AND b IS NULL").count()


def test_a_grid_scores_every_point(grid_rows):
    points = trees.grid_points(maxDepth=(1, 3, 5), minInstancesPerNode=(1, 40))
    fitted = trees.fit_grid(grid_rows, list("abcd"), "y", "dtree", "clf", points, folds=3)
    assert len(fitted.scores) == 6 and all(0.5 < s <= 1 for s in fitted.scores)
    assert fitted.scores[fitted.best] == max(fitted.scores)
    one = fitted.predict(grid_rows.filter("fold = 0"))
    assert one.filter("prediction IS NULL").isEmpty()


@pytest.mark.parametrize(
    ("name", "more", "kind", "target"),
    [("rforest", {"numTrees": (2, 5), "maxDepth": (2, 3)}, "reg", "z"), ("gboosting", {"maxIter": (2, 4), "maxDepth": (2,)}, "clf", "y")],
)
def test_grids_of_forests_and_chains(spark, grid_rows, name, more, kind, target):
    """Every point once, accuracies from 0 to 1, errors below the target's own spread."""
    points = trees.grid_points(**more)
    fitted = trees.fit_grid(grid_rows, list("abcd"), target, name, kind, points, folds=3)
    table = trees.grid_table(spark, fitted).collect()
    assert sorted(r["params"] for r in table) == sorted(str(dict(sorted(p.items()))) for p in points)
    spread = float(grid_rows.agg(F.stddev("z")).first()[0])
    assert all(0.5 < s <= 1 if kind == "clf" else 0 < s < spread for s in fitted.scores)
    assert (fitted.fitted_rows, fitted.left_out_rows) == (600, 0)


def test_a_grid_without_folds_or_rows(grid_rows):
    points = trees.grid_points(maxDepth=(1, 3))
    single = trees.fit_grid(grid_rows.filter("fold = 1"), list("abcd"), "y", "dtree", "clf", points, folds=3)
    assert single.scores == [None, None] and single.model is not None
    none = trees.fit_grid(grid_rows.limit(0), list("abcd"), "y", "dtree", "clf", points, folds=3)
    assert none.model is None and none.predict(grid_rows).filter("prediction IS NOT NULL").isEmpty()


def test_report_of_scored_rows(spark):
    from aftershock.plans.scoring import score_report
    from aftershock.settings import THRESHOLDS

    spec = SweepSpec("ALL_NO_1_1_1", horizon="0_30", direction="max")
    limit = THRESHOLDS[0, 30]
    pips = [limit + 5, limit + 1, limit - 3, 0, None, limit + 9]
    guess = [1, 0, 1, 0, 1, None]
    rows = [(f"2024-01-0{i + 1}", p, g, None if g is None else 10.0) for i, (p, g) in enumerate(zip(pips, guess, strict=True))]
    df = spark.createDataFrame(
        rows + rows[:2], f"datetime string, {spec.target} int, {spec.label}_predicted int, {spec.target}_predicted double"
    )
    r = score_report(df, spec).first()
    assert (r["support_above_TH"], r["support_below_TH"], r["f1_microavg"]) == (2, 2, 0.5)
    errors = [(p - 10.0) ** 2 for p in pips[:4]]
    assert abs(r["rmse"] - (sum(errors) / 4) ** 0.5) < 1e-4
