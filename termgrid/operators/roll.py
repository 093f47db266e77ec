"""The roll: which expiry is held on each date, and the series of the held contract.

A difference across a roll is a calendar spread, not a market move, so every lag of a price is taken within its expiry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.rolling import expanding, ln, over


def eligible(panel: DataFrame, months: tuple[int, ...] = (), exit_day: int = 20, oi: str = "oi") -> DataFrame:
    """panel's rows that may be held: before the exit day of the month before delivery, with an open interest of the row before.

    Adds oi_lag (lagged within contract and expiry) and expiry_month.
    """
    first = F.to_date(F.concat("expiry", F.lit("-01")))
    df = panel.withColumn("expiry_month", F.month(first)).withColumn("oi_lag", F.lag(oi).over(over(["contract", "expiry"], "dt")))
    if months:
        df = df.filter(F.col("expiry_month").isin(*months))
    return df.filter((F.col("dt") <= F.date_add(F.add_months(first, -1), exit_day - 1)) & F.col("oi_lag").isNotNull())


@udtf(returnType="contract string, dt date, expiry string")
class HeldExpiry:
    """The expiry held on each day, from rows (contract, dt, expiries by rising claim) in order of dt."""

    def __init__(self):
        self.held = ""

    def eval(self, row: Row):
        expiries = row["expiries"]
        may = [e for e in expiries if e >= self.held] if self.held in expiries else expiries
        self.held = may[-1]
        yield row["contract"], row["dt"], self.held


def roll_spine(panel: DataFrame, months: tuple[int, ...] = (), exit_day: int = 20, monotonic: bool = True) -> DataFrame:
    """contract, dt, expiry, expiry_month, oi: the expiry with the largest lagged open interest, never an earlier one than held.

    Ties go to the later expiry. If the held expiry is not eligible on a date, any may be chosen. The days of a contract stream
    through a table function in order; all that it keeps is the held expiry, and a day is one row with its eligible expiries.
    """
    ok = eligible(panel, months, exit_day)
    if not monotonic:
        best = ok.groupBy("contract", "dt").agg(F.max(F.struct("oi_lag", "expiry", "expiry_month", "oi")).alias("c"))
        return best.select("contract", "dt", *[F.col("c")[x].alias(x) for x in ("expiry", "expiry_month", "oi")])

    days = ok.groupBy("contract", "dt").agg(F.array_sort(F.collect_list(F.struct("oi_lag", "expiry"))).alias("c"))
    days = days.select("contract", "dt", F.transform("c", lambda s: s.expiry).alias("expiries"))
    chosen = HeldExpiry(days.asTable().partitionBy("contract").orderBy("dt"))
    return chosen.join(ok.select("contract", "dt", "expiry", "expiry_month", "oi"), ["contract", "dt", "expiry"]).select("contract", "dt", "expiry", "expiry_month", "oi")


def within_contract_returns(panel: DataFrame, price: str, keys: tuple[str, ...] = ("contract", "expiry")) -> DataFrame:
    """panel with log_price and ret: the change of the logarithm within the expiry."""
    w = over(list(keys), "dt")
    df = panel.withColumn("log_price", ln(F.col(price)))
    return df.withColumn("ret", F.col("log_price") - F.lag("log_price").over(w))


def within_contract_lags(panel: DataFrame, value: str, lags: int = 1) -> DataFrame:
    w = over(["contract", "expiry"], "dt")
    df = panel.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})
    return df.withColumn(f"{value}_diff", F.col(value) - F.col(f"{value}_lag1"))


def liquid_series(spine: DataFrame, panel: DataFrame, spread: str = "spread", legs: tuple[str, ...] = ("price", "usd", "cbot")) -> DataFrame:
    """The held contract's rows: arb_level, arb_change, log_arb_change, each leg's log return, is_roll; blank on a roll.

    Changes are taken within the expiry before the spine picks rows. The first row of a contract counts as a roll.
    """
    w = over(["contract", "expiry"], "dt")
    own = panel.withColumns({"arb_change": F.col(spread) - F.lag(spread).over(w), "log_arb_change": F.col("log_spread") - F.lag("log_spread").over(w), **{f"{x}_log_return": ln(F.col(x)) - F.lag(ln(F.col(x))).over(w) for x in legs}})
    held = spine.select("contract", "dt", "expiry").join(own, ["contract", "dt", "expiry"])
    held = held.withColumn("is_roll", F.coalesce(F.col("expiry") != F.lag("expiry").over(over("contract", "dt")), F.lit(True)))
    keep = lambda c: F.when(~F.col("is_roll"), F.col(c))
    return held.withColumns({c: keep(c) for c in ("arb_change", "log_arb_change", *[f"{x}_log_return" for x in legs])}).withColumn("arb_level", F.col(spread))


def continuous(held: DataFrame, prices: tuple[str, ...], spreads: tuple[str, ...], series: str = "contract") -> DataFrame:
    """Roll-safe levels of a held series: clog_<price> and c_<spread> from changes within the expiry.

    The running sum of the changes (a missing one counts 0) starts at the first level; it is null where the level is.
    """
    inner, outer = over([series, "expiry"], "dt"), over(series, "dt")
    out = {}
    for p in prices:
        log = ln(F.col(p))
        out[f"log_{p}"], out[f"ret_{p}"] = log, log - F.lag(log).over(inner)
    df = held.withColumns(out).withColumns({f"diff_{s}": F.col(s) - F.lag(s).over(inner) for s in spreads})
    rebuild = lambda change, level: F.when(F.col(level).isNotNull(), F.sum(F.coalesce(F.col(change), F.lit(0.0))).over(expanding(outer)) + F.first(level, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.withColumns({**{f"clog_{p}": rebuild(f"ret_{p}", f"log_{p}") for p in prices}, **{f"c_{s}": rebuild(f"diff_{s}", s) for s in spreads}})
