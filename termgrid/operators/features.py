"""Rolling features and forward targets of ordered series. All functions add columns; windows share one partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.ordered import ewm_means, trailing_rank


def ma_distance(df: DataFrame, x: str, w: WindowSpec, windows: tuple[int, ...], z_window: int) -> DataFrame:
    """<x>_ma_<n> and the z-score of the distance from it."""
    df = df.withColumns({f"{x}_ma_{n}": R.rolling(F.avg, F.col(x), w, n) for n in windows})
    df = df.withColumns({f"_d{n}": F.col(x) - F.col(f"{x}_ma_{n}") for n in windows})
    return df.withColumns({f"{x}_ma_dist_z_{n}": R.zscore(F.col(f"_d{n}"), w, z_window) for n in windows}).drop(*[f"_d{n}" for n in windows])


def ma_momentum(df: DataFrame, x: str, series: str, order: str, fast: int, slow: int, above: int, z_window: int, spans: tuple[int, int] = (12, 26)) -> DataFrame:
    """z-scores of the fast average less the slow one and of the difference of exponential means; share of rows above the average.

    A row without an average counts as not above.
    """
    v, w = F.col(x), R.over(series, order)
    df = ewm_means(df, series, order, x, {"_fast": spans[0], "_slow": spans[1]})
    df = df.withColumns({"_cross": R.rolling(F.avg, v, w, fast) - R.rolling(F.avg, v, w, slow), "_macd": F.col("_fast") - F.col("_slow"), "_above": F.coalesce(v > R.rolling(F.avg, v, w, above), F.lit(False)).cast("double")})
    out = {"ma_cross_z": R.zscore(F.col("_cross"), w, z_window), "macd_z": R.zscore(F.col("_macd"), w, z_window), "above_ma": R.rolling(F.avg, F.col("_above"), w, above)}
    return df.withColumns(out).drop("_cross", "_macd", "_above", "_fast", "_slow")


def vol_regime(df: DataFrame, x: str, series: str, order: str, windows: tuple[int, ...], rank_window: int) -> DataFrame:
    """Rolling deviation of the changes, and the trailing percent rank of the last window's, ranked to 9 decimals."""
    w = R.over(series, order)
    df = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    df = df.withColumns({f"vol_{n}": F.round(R.rolling(F.stddev_samp, F.col("_d"), w, n), 9) for n in windows})
    return trailing_rank(df.drop("_d"), series, order, f"vol_{windows[-1]}", "vol_rank", rank_window)


def volume_ratios(df: DataFrame, x: str, w: WindowSpec, ratio: int = 20, short: int = 5, long: int = 20) -> DataFrame:
    v = F.col(x)
    return df.withColumns({"volume_ratio": R.ratio(v, R.rolling(F.avg, v, w, ratio)), "volume_trend": R.ratio(R.rolling(F.avg, v, w, short), R.rolling(F.avg, v, w, long))})


def volume_features(df: DataFrame, x: str, w: WindowSpec, windows: tuple[int, ...] = (20,)) -> DataFrame:
    v = F.col(x)
    return df.withColumns({k: c for n in windows for k, c in ((f"{x}_ma_{n}", R.rolling(F.avg, v, w, n)), (f"{x}_rel_{n}", R.ratio(v, R.rolling(F.avg, v, w, n))), (f"{x}_z_{n}", R.zscore(v, w, n)))})


def calendar(df: DataFrame, dt: str, harvest_month: int = 4) -> DataFrame:
    """Yearly sine and cosine, and days to the harvest's first day; past days of the harvest month count below 0."""
    d = F.col(dt)
    angle = F.dayofyear(d) * (2 * math.pi / 365.25)
    year = F.year(d) + F.when(F.month(d) > harvest_month, 1).otherwise(0)
    return df.withColumns({"season_sin": F.sin(angle), "season_cos": F.cos(angle), "days_to_harvest": F.datediff(F.make_date(year, F.lit(harvest_month), F.lit(1)), d)})


def time_of_day(df: DataFrame, ts: str, session_hour: int = 1) -> DataFrame:
    """hour, minutes since the session opened (0 before), day of week from Monday as 0."""
    m = F.hour(ts) * 60 + F.minute(ts) - session_hour * 60
    return df.withColumns({"hour": F.hour(ts), "minutes_since_open": F.greatest(m, F.lit(0)), "day_of_week": F.weekday(ts)})


def add_lags(df: DataFrame, columns: tuple[str, ...], w: WindowSpec, n: int) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, n + 1)})


def log_returns(df: DataFrame, columns: tuple[str, ...], w: WindowSpec) -> DataFrame:
    """Plain log returns, across whatever the rows are."""
    return df.withColumns({f"{c}_ret": R.ln(F.col(c)) - F.lag(R.ln(F.col(c))).over(w) for c in columns})


def forward_targets(df: DataFrame, x: str, w: WindowSpec, horizons: tuple[int, ...], vol_window: int = 20) -> DataFrame:
    """target_raw_<h>_d: the change over the h rows ahead; target_<h>_d: the same over the recent deviation times root h."""
    df = df.withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_s", R.rolling_std(F.col("_d"), w, vol_window))
    raw = {f"target_raw_{h}_d": F.lead(x, h).over(w) - F.col(x) for h in horizons}
    return df.withColumns(raw).withColumns({f"target_{h}_d": F.col(f"target_raw_{h}_d") / (F.col("_s") * math.sqrt(h)) for h in horizons}).drop("_d", "_s")


def hedge_ratio(x: str, y: str, w: WindowSpec, n: int) -> Column:
    """Rolling regression slope of x on y, on levels."""
    return R.pair(F.covar_samp, F.col(x), F.col(y), w, n) / F.nullif(R.pair(lambda a, b: F.var_samp(b), F.col(x), F.col(y), w, n), F.lit(0.0))


def hedged_spread(df: DataFrame, x: str, y: str, w: WindowSpec, n: int = 120, every: int = 5) -> DataFrame:
    """beta: slope of x's changes on y's, held between rebalances; hedged: the sum of changes hedged with the beta before."""
    df = df.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_dy": F.col(y) - F.lag(y).over(w)})
    df = df.withColumn("_b", hedge_ratio("_dx", "_dy", w, n)).withColumn("beta", R.rebalanced(F.col("_b"), w, every))
    df = df.withColumn("hedged_change", F.col("_dx") - F.lag("beta").over(w) * F.col("_dy"))
    return df.withColumn("hedged", R.running_sum(F.col("hedged_change"), w)).drop("_dx", "_dy", "_b")


def spread_state(df: DataFrame, x: str, w: WindowSpec, n: int = 60, lag: int = 5) -> DataFrame:
    """Half-life of reversion and the variance ratio of lag-row changes to one-row changes."""
    df = df.withColumns({"_l": F.lag(x).over(w), "_k": F.col(x) - F.lag(x, lag).over(w), "_d": F.col(x) - F.lag(x).over(w)})
    return df.withColumns({"half_life": R.ou_half_life(F.col(x), F.col("_l"), w, n), "variance_ratio": R.rolling(F.var_samp, F.col("_k"), w, n) / (F.nullif(R.rolling(F.var_samp, F.col("_d"), w, n), F.lit(0.0)) * lag)}).drop("_l", "_k", "_d")


def cross_legs(df: DataFrame, x: str, y: str, w: WindowSpec, n: int = 60) -> DataFrame:
    """Rolling correlation of two legs' changes and the ratio of their deviations."""
    df = df.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_dy": F.col(y) - F.lag(y).over(w)})
    return df.withColumns({"leg_corr": R.pair(F.corr, F.col("_dx"), F.col("_dy"), w, n), "relative_vol": R.rolling(F.stddev_samp, F.col("_dx"), w, n) / F.nullif(R.rolling(F.stddev_samp, F.col("_dy"), w, n), F.lit(0.0))}).drop("_dx", "_dy")


def frozen_hedge_ratio(df: DataFrame, x: str, y: str, w: WindowSpec, n: int = 120, every: int = 5) -> DataFrame:
    """hedge_ratio: the slope of the levels, held between rebalances."""
    return df.withColumn("_h", hedge_ratio(x, y, w, n)).withColumn("hedge_ratio", R.rebalanced(F.col("_h"), w, every)).drop("_h")


def beta_stability(df: DataFrame, x: str, y: str, w: WindowSpec, fast: int = 60, slow: int = 120, n: int = 60) -> DataFrame:
    """beta_std: the deviation of the slow slope over n rows; beta_gap: the fast slope of the changes less the slow one."""
    df = df.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_dy": F.col(y) - F.lag(y).over(w)})
    df = df.withColumns({"_f": hedge_ratio("_dx", "_dy", w, fast), "_s": hedge_ratio("_dx", "_dy", w, slow)})
    return df.withColumns({"beta_std": R.rolling(F.stddev_samp, F.col("_s"), w, n), "beta_gap": F.col("_f") - F.col("_s")}).drop("_dx", "_dy", "_f", "_s")


def within_expiry(df: DataFrame, x: str, volume: str, z_window: int = 120, vol_window: int = 60, ratio: int = 20, short: int = 5, long: int = 20) -> DataFrame:
    """<x>_z, <x>_vol (deviation of the changes), volume_ratio and volume_trend, all windows within contract and expiry."""
    w = R.over(["contract", "expiry"], "dt")
    df = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    df = df.withColumns({f"{x}_z": R.zscore(F.col(x), w, z_window), f"{x}_vol": R.rolling(F.stddev_samp, F.col("_d"), w, vol_window)}).drop("_d")
    return volume_ratios(df, volume, w, ratio, short, long)


def prepare_arb(df: DataFrame, w: WindowSpec, level: str, gap: str, legs: tuple[str, ...]) -> DataFrame:
    """arb_level, arb_change and the legs on one mask: on rows where the column gap is missing changes and legs count 0."""
    open_ = F.col(gap).isNull()
    masked = lambda c: F.coalesce(F.when(~open_, c), F.lit(0.0))
    return df.withColumns({"arb_level": F.col(level), "arb_change": masked(F.col(level) - F.lag(level).over(w)), **{leg: masked(F.col(leg)) for leg in legs}, "is_gap": open_})
