"""Values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# They must equal these for results to be right.
CANDLE_MINUTES = 5
BEFORE_MINUTES = 60
SNAPSHOT_ENDS = (5, 10, 15, 20, 25, 30)
HORIZON_STARTS = (0, 30, 60)
HORIZON_ENDS = (30, 60, 120, 180, 240)
HISTORY_ROWS = 5
INVALID_SURPRISE = 9999.0

# Pips from which a reaction counts as big, by (from, to) minutes.
THRESHOLDS = {
    (0, 30): 18,
    (0, 60): 24,
    (0, 120): 32,
    (0, 180): 37,
    (0, 240): 40,
    (30, 60): 15,
    (30, 120): 26,
    (30, 180): 32,
    (30, 240): 36,
    (60, 120): 20,
    (60, 180): 27,
    (60, 240): 31,
}

IMPACTS = ("High", "Medium", "Low")
FLAGS = ("accurate", "better", "worse")
IMPACT_WEIGHT = {"Low": 1, "Medium": 2, "High": 3}

# Display text of the two directions of a model.
DIRECTION_TEXT = {
    "max": "max number of pips increased is above the TH",
    "min": "max number of pips decreased is above the TH",
}

# Bounds of the dashboard's score filter.
PRECISION_RANGE = (0.694, 1.0)
RECALL_RANGE = (0.103, 0.59)

# Display order of the bundle variants.
VARIANT_ORDER = (
    "High_YES_1_1_1",
    "High_NO_1_1_1",
    "ALL_NO_1_1_1",
    "ALL_NO_3_2_1",
    "ALL_YES_1_1_1",
    "ALL_YES_3_2_1",
)

# Model grids.
NEIGHBOURS = tuple(range(1, 200, 10))
TREE_DEPTHS = tuple(range(2, 8))
LEAF_ROWS = (10, 20, 30, 50, 100, 150, 200, 250)
TREE_COUNTS = (10, 50, 100, 200)
BOOST_ROUNDS = (10, 50, 100, 200)
TEST_SHARE = 0.2
FOLDS = 5
# ----------------------------------------------------------------------------


def horizons(starts=HORIZON_STARTS, ends=HORIZON_ENDS) -> list[tuple[int, int]]:
    """All (from, to) pairs with from < to, in minutes."""
    return [(a, b) for a in starts for b in ends if a < b]


@dataclass(frozen=True)
class CurationConfig:
    """What a curation run needs to know."""

    currency: str = "USD"
    pair: str | None = None
    snapshot_ends: tuple[int, ...] = SNAPSHOT_ENDS
    starts: tuple[int, ...] = HORIZON_STARTS
    ends: tuple[int, ...] = HORIZON_ENDS
    before_minutes: int = BEFORE_MINUTES
    dst_correction: bool = True
    expected_weeks: int | None = None
    exempt_years: tuple[int, ...] = ()
    # "rows": frames of candles, reaching over gaps; "time": frames of minutes.
    frame: str = "rows"
    include_release_candle: bool = True
