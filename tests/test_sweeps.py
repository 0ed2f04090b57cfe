"""The work table of a plan, and runs that share it."""

import time

import pytest

from aftershock.catalog import scans
from aftershock.operators import trees
from aftershock.operators.accounting import Account, keep_complete, ledger
from aftershock.plans import sweeps
from aftershock.plans.scoring import score_accounted
from aftershock.plans.sweeps import SweepSpec, run_sweeps, sweep_results
from aftershock.plans.worktable import CLAIMED, DONE, FAILED, WorkTable

SPECS = [SweepSpec("ALL_NO_1_1_1"), SweepSpec("ALL_NO_1_1_1", direction="min")]
GRID = {"dtree": trees.grid_points(maxDepth=(2, 3), minInstancesPerNode=(5, 20))}


@pytest.fixture(scope="module")
def features(spark, sf):
    return scans.scored_features(spark, sf).cache()


def units(df):
    return sorted((r["sweep_id"], r["model"], r["model_type"]) for r in df.collect())


def expected(*models):
    return sorted((s.sweep_id, m, kind) for s in SPECS for m in models for kind in ("clf", "reg"))


def test_two_runs_with_other_models_give_the_union(spark, features, tmp_path, monkeypatch):
    path = str(tmp_path / "plan")
    first = run_sweeps(features, SPECS, GRID, path, neighbours=(), folds=3)
    assert units(first) == expected("dtree")
    searches, plain = [], sweeps.nearest
    monkeypatch.setattr(sweeps, "nearest", lambda *a, **b: searches.append(1) or plain(*a, **b))
    monkeypatch.setattr(sweeps, "grid_results", lambda *a, **b: pytest.fail("done already"))
    second = run_sweeps(features, SPECS, GRID, path, neighbours=(1, 3), folds=3)
    assert units(second) == expected("dtree", "kn")
    # One search for the grid and one for the test rows, for both kinds.
    assert len(searches) == 2 * len(SPECS)
    accounts = {}
    for r in sweeps.sweep_accounts(spark, path).collect():
        accounts.setdefault(r["job"], {})[r["reason"]] = r["rows"]
    assert set(accounts) == {s.sweep_id for s in SPECS}
    for told in accounts.values():
        assert told["read"] == sum(n for reason, n in told.items() if reason != "read") > told["kept"] > 0


def test_every_row_is_kept_or_has_a_reason(spark):
    rows = [(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, None, None), (None, "e", 5.0)]
    df = spark.createDataFrame(rows, "id int, `odd name` string, x double")
    kept, rejects, account = keep_complete(df, "job", ["odd name", "x"])
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter("`odd name` IS NOT NULL AND x IS NOT NULL").collect()))
    assert {(r["id"], r["reason"]) for r in rejects.collect()} == {(2, "odd name"), (3, "x"), (4, "odd name")}
    assert (account.read, account.kept, account.left_out, account.balanced) == (5, 2, {"odd name": 2, "x": 1}, True)
    none, _, empty = keep_complete(df.limit(0), "none")
    assert none.count() == 0 and (empty.read, empty.kept) == (0, 0)
    assert ledger(spark, [account, empty]).count() == 6
    with pytest.raises(ValueError, match="do not add up"):
        ledger(spark, [Account("bad", 3, 1, {"x": 1})])


def test_scoring_tells_what_it_left_out(spark, features):
    from pyspark.sql import functions as F

    scored, accounts = score_accounted(features, F.lit(scans.CUT).cast("timestamp"), SPECS[0], 3)
    learnt, later = accounts
    assert learnt.balanced and later.balanced and scored.count() == features.count()
    instants = features.select("datetime").distinct()
    assert learnt.read + later.read == instants.count()
    guessed = scored.filter(f"{SPECS[0].label}_predicted IS NOT NULL").select("datetime").distinct()
    assert guessed.count() == later.kept


@pytest.mark.filterwarnings("ignore::pytest.PytestUnhandledThreadExceptionWarning")
def test_a_killed_run_goes_on(spark, features, tmp_path, monkeypatch):
    """A run dies after writing rows and before marking them; the next one does what is left, once."""
    path = str(tmp_path / "plan")
    plain = WorkTable._append

    def dies(self, unit, state, attempt, note=""):
        if state == DONE and unit.startswith(SPECS[1].sweep_id):
            raise KeyboardInterrupt
        plain(self, unit, state, attempt, note)

    monkeypatch.setattr(WorkTable, "_append", dies)
    with pytest.raises((KeyboardInterrupt, RuntimeError)):
        run_sweeps(features, SPECS, GRID, path, neighbours=(), folds=3, workers=1)
    monkeypatch.setattr(WorkTable, "_append", plain)
    assert {s for s, _, _ in units(sweep_results(spark, path))} == {SPECS[0].sweep_id}
    states = {r["unit"]: r["state"] for r in WorkTable(spark, path).states().collect()}
    assert sorted(states.values()) == [CLAIMED, DONE]
    # While the dead run's lease holds, its unit is left alone.
    assert len(units(run_sweeps(features, SPECS, GRID, path, neighbours=(), folds=3, lease_minutes=60))) == 2
    assert units(run_sweeps(features, SPECS, GRID, path, neighbours=(), folds=3)) == expected("dtree")


def test_failed_units_are_told_and_tried_again(spark, tmp_path):
    work = WorkTable(spark, str(tmp_path / "work"))
    assert work.results() is None and work.states().count() == 0
    fine = spark.range(3)
    jobs = {"a": lambda: fine, "b": lambda: fine.selectExpr("no_such_column"), "c": lambda: fine}
    with pytest.raises(RuntimeError, match="1 of 3 units failed"):
        work.run_all(jobs, workers=2)
    states = {r["unit"]: r for r in work.states().collect()}
    assert {u: r["state"] for u, r in states.items()} == {"a": DONE, "b": FAILED, "c": DONE}
    assert "no_such_column" in states["b"]["note"]
    assert work.results().count() == 6
    again = WorkTable(spark, work.path)
    assert again.open_units(jobs) == ["b"]
    again.run_all(jobs | {"b": lambda: fine})
    assert again.results().count() == 9 and again.open_units(jobs) == []


def test_a_unit_done_twice_counts_once(spark, tmp_path):
    a, b = (WorkTable(spark, str(tmp_path / "work")) for _ in range(2))
    assert a.do("u", lambda: spark.range(2)) and b.do("u", lambda: spark.range(5))
    assert a.results().count() == b.results().count() == 2


def test_leases(spark, tmp_path):
    path = str(tmp_path / "work")
    WorkTable(spark, path)._append("u", CLAIMED, "x")
    assert WorkTable(spark, path, lease_minutes=10).open_units(["u"]) == []
    time.sleep(0.1)
    assert WorkTable(spark, path, lease_minutes=0.001).open_units(["u"]) == ["u"]
