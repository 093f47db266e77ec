"""Whole pipelines as single lazy plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import features, panel, roll


@dataclass(frozen=True)
class Panels:
    """The spread panel, the roll spine and the held series of all contracts."""

    panel: DataFrame
    spine: DataFrame
    liquid: DataFrame


def build_panels(domestic: DataFrame, offshore: DataFrame, fx: DataFrame, months: tuple[int, ...] = (), exit_day: int = 20) -> Panels:
    """Both contracts in one plan, with contract as a partition column instead of a loop."""
    p = panel.build_spread(domestic, offshore, fx)
    spine = roll.roll_spine(p, months, exit_day)
    return Panels(p, spine, roll.liquid_series(spine, p))


def combined_frame(p: Panels, one: str, other: str, horizons: tuple[int, ...] = (1, 5, 21), z_window: int = 20) -> DataFrame:
    """The held rows of one contract with its z-scores and forward moves, and the other grade's spread where it exists."""
    w = R.over(["contract", "expiry"], "dt")
    own = p.panel.filter(F.col("contract") == one)
    own = own.withColumns({"arb_z": R.zscore(F.col("spread"), w, z_window), "own_z": R.zscore(F.col("usd"), w, z_window), "cbot_z": R.zscore(F.col("cbot"), w, z_window), **{f"fwd_{h}": F.lead("usd", h).over(w) - F.col("usd") for h in horizons}})
    grades = panel.two_grades(p.panel, one, other).select("dt", "expiry", "grade_spread", "grade_z", "grade_change")
    held = p.spine.filter(F.col("contract") == one).select("dt", "expiry")
    return held.join(own, ["dt", "expiry"]).join(grades, ["dt", "expiry"], "left")


def feature_frame(held: DataFrame) -> DataFrame:
    """Roll-safe levels of a held series with momentum, volatility, calendar features and targets."""
    w = R.over("contract", "dt")
    df = roll.continuous(held, ("usd", "cbot"), ("spread",))
    df = features.ma_momentum(df, "clog_usd", "contract", "dt", 10, 40, 20, 60)
    df = features.vol_regime(df, "clog_usd", "contract", "dt", (20,), 252)
    df = features.spread_state(df, "c_spread", w)
    df = features.cross_legs(df, "clog_usd", "clog_cbot", w)
    df = features.calendar(df, "dt")
    return features.forward_targets(df, "clog_usd", w, (1, 5, 20))
