"""Every registered query beside its reference SQL."""

import pytest

import __spark_entry__ as contract
from aftershock.plans.sweeps import NOTHING_SCORED
from compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_reference_sql(spark, con, sf, name):
    found, _ = differences(spark, con, QUERIES[name], ORACLES[name], sf)
    assert not found


@pytest.mark.parametrize("name", ["tree_grid", "run_sweeps"])
def test_model_jobs_give_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    if name == "run_sweeps":
        rows = df.collect()
        assert {r["model"] for r in rows} == {"kn", "dtree"}
        assert {r["model_type"] for r in rows} == {"clf", "reg"}
        # The second variant keeps too few complete rows of the smallest table to test on.
        scored = [r for r in rows if r["report"] != NOTHING_SCORED]
        assert scored and all((r["f1_microavg"] is None) == (r["model_type"] == "reg") for r in scored)
        assert all(r["f1_microavg"] is None for r in rows if r["report"] == NOTHING_SCORED)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["indicator", "impact", "releases", "avg_pips", "max_pips"]
    assert df.count() > 0
