"""Training tables and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.catalog.registry import query
from aftershock.catalog.scans import CUT, SPEC, dataset_sql, half_hour, scored_features
from aftershock.catalog.sql import sql
from aftershock.operators import neighbours, reports, reshape, tree_levels, trees
from aftershock.operators.accounting import keep_complete, ledger
from aftershock.operators.lattice import all_bundles
from aftershock.plans.scoring import score_new, score_report
from aftershock.plans.sweeps import (
    BUNDLE_FIRSTS,
    BUNDLE_SUMS,
    SweepSpec,
    feature_names,
    lattice_of,
    run_sweeps,
    sweep_dataset,
    sweep_plan,
)
from aftershock.session import stored
from aftershock.settings import (
    BOOST_ROUNDS,
    FLAGS,
    FOLDS,
    IMPACTS,
    LEAF_ROWS,
    NEIGHBOURS,
    TEST_SHARE,
    TREE_COUNTS,
    TREE_DEPTHS,
)

C = F.col

_PLAN = """
SELECT concat_ws('-', agg, features, before_data, horizon, 'basic', direction) AS sweep_id, agg AS sweep_news_agg,
 features, before_data, horizon, 'basic' AS grid, direction,
 CAST(split_part(horizon, '_', 1) AS INT) AS from_min, CAST(split_part(horizon, '_', 2) AS INT) AS to_min,
 split_part(horizon, '_', 2) IN ('30', '60', '120', '180', '240') AS valid,
 CASE WHEN isolated = 'YES' THEN singles ELSE instants END AS bundles
FROM (SELECT *, concat_ws('_', impact, isolated, weights) AS agg FROM
  (SELECT impact, count(*) AS instants, count(*) FILTER (WHERE n = 1) AS singles FROM
    (SELECT impact, datetime, count(*) AS n FROM rc GROUP BY impact, datetime
     UNION ALL SELECT 'ALL', datetime, count(*) FROM rc GROUP BY datetime) GROUP BY impact),
  (SELECT unnest(['NO', 'YES']) AS isolated), (SELECT unnest(['1_1_1', '3_2_1']) AS weights),
  (SELECT unnest(['basic', 'all']) AS features), (SELECT unnest(['included', 'excluded']) AS before_data),
  (SELECT unnest(['0_30', '0_60', '30_60', '30_90']) AS horizon), (SELECT unnest(['max', 'min']) AS direction))
"""


@query("sweep_plan", sql(_PLAN, "rc"))
def _sweep_plan(spark, sf_dir):
    return sweep_plan(fx.clean(spark, sf_dir))


def _bundles_sql() -> str:
    """Every aggregation as a query of its own."""
    flags = {f"{p}_{v}": f"{n} = '{v}'" for p, n in (("fe", "forecast_error"), ("pe", "previous_error")) for v in FLAGS}
    parts = []
    for impact in ("ALL", *IMPACTS):
        for text in ("1_1_1", "3_2_1"):
            high, medium, low = text.split("_") if impact == "ALL" else "111"
            w = f"CASE impact WHEN 'High' THEN {high} WHEN 'Medium' THEN {medium} WHEN 'Low' THEN {low} ELSE 0 END"
            sums = [
                f"CAST(sum(CASE WHEN {flags[c]} THEN {w} ELSE 0 END) AS BIGINT) AS {c}" if c in flags
                else f"CAST(sum({c} * {w}) AS BIGINT) AS {c}" if c.endswith("class")
                else f"round(sum({c} * {w}), 2) AS {c}"
                for c in BUNDLE_SUMS
            ]
            sums += [f"count(*) FILTER (WHERE impact = '{i}') AS \"{i}\"" for i in IMPACTS]
            sums += [f"arg_min({c}, event_id) AS {c}" for c in BUNDLE_FIRSTS]
            where = "" if impact == "ALL" else f"WHERE impact = '{impact}' "
            for alone, having in (("NO", ""), ("YES", " HAVING count(*) = 1")):
                parts.append(
                    f"SELECT '{impact}_{alone}_{text}' AS aggregation, datetime, count(*) AS num_news, {', '.join(sums)} "
                    f"FROM cs {where}GROUP BY datetime{having}"
                )
    return " UNION ALL ".join(parts)


@query("bundle_lattice", sql(_bundles_sql(), "cs"))
def _bundle_lattice(spark, sf_dir):
    """Bundles of all sixteen aggregations from one scan of the features."""
    lattice = stored(lattice_of(scored_features(spark, sf_dir)), "lattice")
    return all_bundles(lattice, BUNDLE_SUMS, BUNDLE_FIRSTS)


@query("sweep_dataset", sql(dataset_sql(), "cs"))
def _sweep_dataset(spark, sf_dir):
    return sweep_dataset(scored_features(spark, sf_dir), SPEC)


@query(
    "random_split",
    sql(
        "SELECT event_id, CASE WHEN CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) "
        "/ 4294967296.0 < 0.2 THEN 1 ELSE 0 END AS is_test FROM cf",
        "cf",
    ),
)
def _random_split(spark, sf_dir):
    rows = half_hour(spark, sf_dir).select("event_id")
    return reshape.random_split(rows, "event_id", TEST_SHARE)


_NEAR = (
    "SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rank FROM (SELECT a.id AS test_id, "
    "b.id AS train_id, b.label, round(list_distance(a.vector, b.vector), 6) AS dist FROM e a, e b "
    "WHERE a.id % 5 = 0 AND b.id % 5 <> 0) QUALIFY rank <= 191"
)
_KS = f"(SELECT unnest({list(NEIGHBOURS)}) AS k)"


def _sides(spark, sf_dir):
    e = fx.vectors(spark, sf_dir)
    return e.filter(C("id") % 5 == 0), e.filter(C("id") % 5 != 0)


@query(
    "knn_classify",
    sql(
        "SELECT test_id, k, label AS predicted FROM (SELECT test_id, k, label, row_number() OVER (PARTITION BY test_id, k "
        f"ORDER BY count(*) DESC, label) AS i FROM ({_NEAR}), {_KS} WHERE rank <= k GROUP BY test_id, k, label) WHERE i = 1",
        "e",
    ),
)
def _knn_classify(spark, sf_dir):
    test, train = _sides(spark, sf_dir)
    near = neighbours.nearest(test, train, max(NEIGHBOURS), ["label"])
    return neighbours.knn_classify(near, "label")


@query(
    "knn_regress",
    sql(
        "SELECT test_id, k, round(avg(CAST(label AS DOUBLE)), 6) AS predicted FROM "
        f"({_NEAR}), {_KS} WHERE rank <= k GROUP BY test_id, k",
        "e",
    ),
)
def _knn_regress(spark, sf_dir):
    test, train = _sides(spark, sf_dir)
    near = neighbours.nearest(test, train, max(NEIGHBOURS), ["label"])
    return neighbours.knn_regress(near, "label")


_CV_KS = NEIGHBOURS


@query(
    "cross_validate",
    sql(
        "SELECT k, round(avg(acc), 6) AS accuracy FROM (SELECT k, fold, avg(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) "
        "AS acc FROM (SELECT test_id, fold, y, k, label AS predicted, row_number() OVER (PARTITION BY test_id, k "
        "ORDER BY count(*) DESC, label) AS i FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) "
        "AS rank FROM (SELECT a.id AS test_id, a.id % 5 AS fold, a.label AS y, b.id AS train_id, b.label, "
        "round(list_distance(a.vector, b.vector), 6) AS dist FROM e a, e b WHERE a.id % 5 <> b.id % 5) QUALIFY rank <= 191), "
        f"(SELECT unnest({list(_CV_KS)}) AS k) WHERE rank <= k GROUP BY test_id, fold, y, k, label) WHERE i = 1 "
        "GROUP BY k, fold) GROUP BY k",
        "e",
    ),
)
def _cross_validate(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).withColumn("fold", (C("id") % 5).cast("int"))
    return neighbours.cross_validate(rows, "label", "fold", _CV_KS)


@query(
    "vote_ensemble",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN 2 * sum(a + b + c) > 3 * count(*) THEN 1 ELSE 0 END "
    "AS vote FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS a, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END "
    "AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS c FROM lineitem) GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey",
)
def _vote_ensemble(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem")
    guesses = F.array(
        *[
            c.cast("int")
            for c in (C("l_discount") > 0.05, C("l_quantity") > 25, C("l_tax") > 0.04)
        ]
    )
    # one row per model and row, as the models' prediction tables come
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    predictions = rows.select(*keys, F.explode(guesses).alias("yhat"))
    return reports.vote_ensemble(predictions, keys)


# --- tree models --------------------------------------------------------------------------------

_TREE_FEATURES = sorted(
    [f"{m}_{e - 5}_{e}_after" for e in (5, 10, 15, 20, 25, 30) for m in ("volatility", "pips_candle")]
    + ["volatility_60_0_before", "pips_agg_60_0_before", "num_news", "year", "week", "weekday", *IMPACTS]
    + [f"{e}_error_diff_{v}" for e in ("forecast", "previous") for v in ("deviation", "outlier_class")]
    + [f"{p}_{v}" for p in ("fe", "pe") for v in FLAGS]
)


def _levels_sql() -> str:
    """Best splits of the first two levels: every row of a node beside every bound of a bin."""
    n = len(_TREE_FEATURES)
    names = "[" + ", ".join(f"'{f}'" for f in _TREE_FEATURES) + "]"
    values = "[" + ", ".join(f'CAST("{f}" AS DOUBLE)' for f in _TREE_FEATURES) + "]"
    full = " AND ".join(f'"{f}" IS NOT NULL' for f in (*_TREE_FEATURES, SPEC.label, SPEC.target))
    share = "CAST(concat('0x', substr(md5(concat('fold', CAST(datetime AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0"
    sums = ", ".join(
        f"{a}({v}) FILTER (v <= edge) AS l{c}, {a}({v}) AS t{c}"
        for c, a, v in (("n", "count", "*"), ("s", "sum", "y"), ("q", "sum", "y * y"))
    )

    def spread(c: str) -> str:
        m, s, q = (f"({c.format(k)})" for k in "nsq")
        return f"CASE kind WHEN 'clf' THEN 2 * {s} * ({m} - {s}) / {m} ELSE {q} - {s} * {s} / {m} END"

    def gains(counted: str) -> str:
        return (
            f"SELECT *, round(({spread('t{0}')} - ({spread('l{0}')}) - ({spread('t{0} - l{0}')})) / tn, 10) AS gain "
            f"FROM {counted} WHERE ln > 0 AND ln < tn"
        )

    best = "QUALIFY row_number() OVER (PARTITION BY kind, held, leaf, path ORDER BY gain DESC, f, b) = 1"
    return (
        f", d AS (SELECT datetime AS id, CAST(floor({share} * 5) AS INT) AS fold, CAST({SPEC.label} AS DOUBLE) AS c, "
        f"CAST({SPEC.target} AS DOUBLE) AS r, {values} AS x FROM ({dataset_sql()}) WHERE {full}), "
        f"x AS (SELECT id, f, x[f + 1] AS v FROM d, (SELECT unnest(range({n})) AS f)), "
        "ranks AS (SELECT f, list_sort(list(v)) AS vs, count(*) AS n, max(v) AS most FROM x GROUP BY f), "
        "e AS (SELECT f, v AS edge, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS b FROM (SELECT DISTINCT f, most, "
        "vs[CAST(ceil(i * n / 32.0) AS BIGINT)] AS v FROM ranks, (SELECT unnest(range(1, 32)) AS i)) WHERE v < most), "
        "y AS (SELECT id, kind, held, CASE kind WHEN 'clf' THEN c ELSE r END AS y FROM d, (SELECT unnest(['clf', 'reg']) AS kind), "
        "(SELECT unnest([0, 1, 2, 3, 4, -1]) AS held) WHERE fold <> held), "
        f"n0 AS (SELECT kind, held, '' AS path, f, b, edge, {sums} FROM y JOIN x USING (id) JOIN e USING (f) "
        "GROUP BY kind, held, f, b, edge), "
        f"leaves AS (SELECT unnest({list(LEAF_ROWS)}) AS leaf), "
        f"s0 AS (SELECT * FROM ({gains('n0')}), leaves WHERE gain > 0 AND least(ln, tn - ln) >= leaf {best}), "
        # The children of each different split.
        "k AS (SELECT y.id, kind, held, s.f AS sf, s.b AS sb, CASE WHEN x.v <= s.edge THEN 'L' ELSE 'R' END AS path, y.y "
        "FROM y JOIN (SELECT DISTINCT kind, held, f, b, edge FROM s0) s USING (kind, held) JOIN x ON x.id = y.id AND x.f = s.f), "
        f"n1 AS (SELECT kind, held, sf, sb, path, f, b, edge, {sums} FROM k JOIN x USING (id) JOIN e USING (f) "
        "GROUP BY kind, held, sf, sb, path, f, b, edge), "
        f"s1 AS (SELECT g.*, s0.leaf FROM ({gains('n1')}) g JOIN s0 ON g.kind = s0.kind AND g.held = s0.held AND g.sf = s0.f "
        f"AND g.sb = s0.b WHERE g.gain > 0 AND least(g.ln, g.tn - g.ln) >= s0.leaf "
        "QUALIFY row_number() OVER (PARTITION BY g.kind, g.held, s0.leaf, g.path ORDER BY g.gain DESC, g.f, g.b) = 1) "
        f"SELECT kind, CAST(held AS INT) AS held_fold, CAST(leaf AS INT) AS leaf_rows, path, ({names})[f + 1] AS feature, edge FROM s0 "
        f"UNION ALL SELECT kind, CAST(held AS INT), CAST(leaf AS INT), path, ({names})[f + 1], edge FROM s1"
    )


@query(
    "grid_folds",
    sql(
        f", d AS ({dataset_sql()}) SELECT CAST(floor(CAST(concat('0x', substr(md5(concat('fold', CAST(datetime AS VARCHAR))), "
        f"1, 8)) AS BIGINT) / 4294967296.0 * 5) AS INT) AS fold, count(*) AS rows, CAST(sum({SPEC.label}) AS BIGINT) AS reached, "
        f"CAST(sum({SPEC.target}) AS BIGINT) AS pips FROM d WHERE "
        + " AND ".join(f'"{f}" IS NOT NULL' for f in (*_TREE_FEATURES, SPEC.label, SPEC.target))
        + " GROUP BY fold",
        "cs",
    ).replace(") , d AS", "), d AS"),
)
def _grid_folds(spark, sf_dir):
    """The rows that grids of tree models are fitted and scored on, by fold."""
    rows, _, _ = keep_complete(sweep_dataset(scored_features(spark, sf_dir), SPEC), "folds")
    return trees.with_folds(rows, "datetime").groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(SPEC.label).alias("reached"), F.sum(SPEC.target).alias("pips")
    )


@query("tree_levels", sql("", "cs").rstrip() + _levels_sql())
def _tree_levels(spark, sf_dir):
    """The first two levels of the trees of a grid: one row for each split of a fold and leaf size."""
    dataset, _, _ = keep_complete(sweep_dataset(scored_features(spark, sf_dir), SPEC), "levels")
    rows = trees.with_folds(dataset, "datetime")
    edges = tree_levels.bin_edges(rows, _TREE_FEATURES)
    out = []
    for kind, target in (("clf", SPEC.label), ("reg", SPEC.target)):
        cells = tree_levels.binned(rows, _TREE_FEATURES, target, edges)
        grown = tree_levels.grow(cells, edges, range(FOLDS), LEAF_ROWS, 2, kind)
        for held, root in grown.roots.items():
            for leaf in LEAF_ROWS:
                splits = list(grown.path(held, leaf, 2))
                names = {root: ""} | {s[k]: side for s in splits if s[0] == root for k, side in ((3, "L"), (4, "R"))}
                for node, f, b, _, _ in splits:
                    out.append((kind, held, leaf, names[node], _TREE_FEATURES[f], float(edges[f][b])))
    schema = "kind string, held_fold int, leaf_rows int, path string, feature string, edge double"
    return spark.createDataFrame(out, schema)


_TREE_SPEC = SweepSpec("ALL_NO_1_1_1", "basic", "included", "0_30", "basic", "max")


def _grid(spark, sf_dir, model, points):
    """Grid scores of both kinds of one model."""
    dataset, _, _ = keep_complete(sweep_dataset(scored_features(spark, sf_dir), _TREE_SPEC), model)
    rows = trees.with_folds(dataset, "datetime")
    names = feature_names(dataset, _TREE_SPEC)
    out = []
    for kind, target in (("clf", _TREE_SPEC.label), ("reg", _TREE_SPEC.target)):
        fitted = trees.fit_grid(rows, names, target, model, kind, points)
        table = trees.grid_table(spark, fitted)
        out.append(table.withColumn("kind", F.lit(kind)).withColumn("score", F.round("score", 4)))
    return out[0].unionByName(out[1])


@query("tree_grid")
def _tree_grid(spark, sf_dir):
    points = trees.grid_points(maxDepth=TREE_DEPTHS, minInstancesPerNode=LEAF_ROWS)
    return _grid(spark, sf_dir, "dtree", points)


@query("forest_grid")
def _forest_grid(spark, sf_dir):
    points = trees.grid_points(maxDepth=TREE_DEPTHS, minInstancesPerNode=LEAF_ROWS, numTrees=TREE_COUNTS)
    return _grid(spark, sf_dir, "rforest", points)


@query("boost_grid")
def _boost_grid(spark, sf_dir):
    points = trees.grid_points(maxIter=BOOST_ROUNDS, maxDepth=(3,))
    return _grid(spark, sf_dir, "gboosting", points)


@query("run_sweeps")
def _run_sweeps(spark, sf_dir):
    specs = [_TREE_SPEC, SweepSpec("High_NO_1_1_1", "basic", "included", "0_60", "basic", "min")]
    grids = {"dtree": trees.grid_points(maxDepth=TREE_DEPTHS, minInstancesPerNode=LEAF_ROWS)}
    return run_sweeps(scored_features(spark, sf_dir), specs, grids).drop("elapsed_time")


def _score_sql() -> str:
    ids = (
        "first_ids AS (SELECT indicator, row_number() OVER (ORDER BY indicator) - 1 AS indicator_id FROM "
        f"(SELECT DISTINCT indicator FROM cs WHERE datetime < TIMESTAMP '{CUT}'))"
    )
    extra = ("min(indicator_id) AS first_indicator_id", "count(DISTINCT indicator_id) AS indicators")
    rows = "(SELECT cs.*, indicator_id FROM cs LEFT JOIN first_ids USING (indicator) WHERE datetime {} TIMESTAMP '" + CUT + "')"
    train = dataset_sql(rows.format("<"), extra)
    test = dataset_sql(rows.format(">="), extra)
    label, pips = SPEC.label, SPEC.target
    columns = [f"{m}_{e - 5}_{e}_after" for e in (5, 10, 15, 20, 25, 30) for m in ("volatility", "pips_candle")]
    columns += ["volatility_60_0_before", "pips_agg_60_0_before", "num_news", "first_indicator_id", "indicators"]
    columns += ["forecast_error_diff_deviation", "previous_error_diff_deviation"]
    columns += ["forecast_error_diff_outlier_class", "previous_error_diff_outlier_class"]
    columns += [f"{p}_{v}" for p in ("fe", "pe") for v in ("accurate", "better", "worse")]
    columns += ['"High"', '"Medium"', '"Low"', "year", "week", "weekday"]
    vector = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (
        f", {ids}, tr AS (SELECT datetime, {vector} AS vector, {label}, {pips} FROM ({train}) WHERE {full} AND {pips} IS NOT NULL), "
        f"te AS (SELECT datetime, {vector} AS vector FROM ({test}) WHERE {full}), "
        f"n AS (SELECT te.datetime, tr.{label}, tr.{pips}, row_number() OVER (PARTITION BY te.datetime ORDER BY "
        "round(list_distance(te.vector, tr.vector), 6), tr.datetime) AS rank FROM te, tr QUALIFY rank <= 11), "
        f"g AS (SELECT datetime, CASE WHEN sum({label}) * 2 > count(*) THEN 1 ELSE 0 END AS {label}_predicted, "
        f"round(avg(CAST({pips} AS DOUBLE)), 6) AS {pips}_predicted FROM n GROUP BY datetime) "
        f"SELECT event_id, {label}_predicted, {pips}_predicted FROM cs LEFT JOIN g USING (datetime)"
    )


@query("score_new", sql("", "cs").rstrip() + _score_sql())
def _score_new(spark, sf_dir):
    scored = score_new(scored_features(spark, sf_dir), F.lit(CUT).cast("timestamp"), SPEC)
    return scored.select("event_id", f"{SPEC.label}_predicted", f"{SPEC.target}_predicted")


_ACCOUNT_COLUMNS = sorted([*_TREE_FEATURES, SPEC.label, SPEC.target])


def _accounts_sql() -> str:
    """Rows of two jobs: read, kept, and left out by the first null column."""

    def job(name: str, columns: list[str], source: str) -> str:
        first = "coalesce(" + ", ".join(f"CASE WHEN \"{c}\" IS NULL THEN '{c}' END" for c in columns) + ")"
        return (
            f"SELECT '{name}' AS job, {first} AS reason, count(*) AS rows FROM {source} WHERE {first} IS NOT NULL GROUP BY reason "
            f"UNION ALL SELECT '{name}', 'read', count(*) FROM {source} "
            f"UNION ALL SELECT '{name}', 'kept', count(*) FROM {source} WHERE {first} IS NULL"
        )

    return (
        f", d AS ({dataset_sql()}) {job('releases', ['actual', 'forecast', 'previous'], 'r')} UNION ALL "
        f"{job('sweep', _ACCOUNT_COLUMNS, 'd')}"
    )


@query("row_accounts", sql("", "cs").rstrip() + _accounts_sql())
def _row_accounts(spark, sf_dir):
    """Where the rows went that a job does not use: rows read are rows kept and rows left out by reason."""
    columns = ["actual", "forecast", "previous"]
    _, _, releases = keep_complete(fx.releases(spark, sf_dir), "releases", columns)
    dataset = sweep_dataset(scored_features(spark, sf_dir), SPEC)
    _, _, sweep = keep_complete(dataset, "sweep", _ACCOUNT_COLUMNS)
    return ledger(spark, [releases, sweep])


@query("score_report")
def _score_report(spark, sf_dir):
    scored = score_new(scored_features(spark, sf_dir), F.lit(CUT).cast("timestamp"), SPEC)
    return score_report(scored, SPEC)
