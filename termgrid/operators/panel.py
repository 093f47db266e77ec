"""Building the panel: guards, snaps, calendar fills, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import fill_forward, over

#: Month codes of futures symbols, fixed values.
MONTH_CODES = {"H": 3, "K": 5, "N": 7, "U": 9, "Z": 12}
CENTS_PER_BUSHEL_TO_USD_PER_TONNE = 39.3683 / 100


def positive_legs(df: DataFrame, *legs: str) -> DataFrame:
    """Rows whose legs are all present and above 0."""
    for leg in legs:
        df = df.filter(F.col(leg) > 0)
    return df


def legs_dropped(df: DataFrame, *legs: str) -> DataFrame:
    """One row: rows, those that positive_legs drops, and for each leg how many lack it or have it at or below 0."""
    bad = lambda leg: F.coalesce(~(F.col(leg) > 0) | F.isnan(leg), F.lit(True))
    any_ = bad(legs[0])
    for leg in legs[1:]:
        any_ = any_ | bad(leg)
    return df.agg(F.count("*").alias("n"), F.count_if(any_).alias("n_dropped"), *[F.count_if(bad(leg)).alias(f"n_{leg}") for leg in legs])


def zero_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """0 stands for a missing value."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in columns})


def usd_per_tonne(cents_per_bushel: Column) -> Column:
    return cents_per_bushel * CENTS_PER_BUSHEL_TO_USD_PER_TONNE


def select_contracts(panel: DataFrame, start_year: int = 2013, months: tuple[int, ...] = (3, 7, 12), least_oi: float = 3000) -> DataFrame:
    """Rows of expiries from a year on, in some delivery months, with enough open interest."""
    first = F.to_date(F.concat("expiry", F.lit("-01")))
    return panel.filter((F.year(first) >= start_year) & F.month(first).isin(*months) & (F.col("oi") >= least_oi))


def date_slice(df: DataFrame, dt: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows between two dates, both included; a date may be a year or a month, which stands for all of it."""
    if first:
        df = df.filter(F.col(dt) >= F.to_date(F.lit(first + "-01-01"[: 10 - len(first)] if len(first) < 10 else first)))
    if last:
        start = F.to_date(F.lit(last + "-01-01"[: 10 - len(last)] if len(last) < 10 else last))
        months = {4: 12, 7: 1}.get(len(last))
        df = df.filter(F.col(dt) < (F.add_months(start, months) if months else F.date_add(start, 1)))
    return df


def rows_before(df: DataFrame, series: str, dt: str, dates: list[str]) -> DataFrame:
    """series, date, position: how many rows of a series lie before each date; dates are few."""
    at = F.array(*[F.struct(F.lit(d).cast("date").alias("date"), F.count_if(F.col(dt) < F.lit(d).cast("date")).alias("position")) for d in dates])
    return df.groupBy(series).agg(at.alias("_a")).select(series, F.inline("_a"))


def hourly_bars_to_snap(bars: DataFrame, cutoff_hour: int = 11, reference_hour: int = 10, max_staleness_hours: float = 30) -> DataFrame:
    """instrument, symbol, expiry, dt, usd_per_tonne, staleness_hours from hourly bars (instrument, symbol, ts, close in cents a bushel).

    Single contracts only; a symbol's expiry follows from its last print, and the query fails where no year fits.
    """
    single = outright_symbols(bars)
    expiry = single.groupBy("instrument", "symbol").agg(F.max("ts").alias("_last")).select("instrument", "symbol", resolve_expiry(F.col("symbol"), F.col("_last"), required=True).alias("expiry"))
    keyed = single.join(expiry, ["instrument", "symbol"]).withColumn("_key", F.struct("instrument", "symbol", "expiry"))
    snap = snap_before(keyed, "_key", "ts", "close", cutoff_hour, reference_hour, max_staleness_hours)
    return snap.select("_key.*", "dt", usd_per_tonne(F.col("close")).alias("usd_per_tonne"), "staleness_hours")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, which raises an error as it runs if two rows share the keys. Grouped by the keys, so a join on them needs no other shuffle."""
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in df.columns if c not in keys])
    refused = F.raise_error(F.concat(F.lit("rows share "), F.to_json(F.struct(*keys)))).cast("boolean")
    return one.filter(F.when(F.col("_n") == 1, True).otherwise(refused)).select(*df.columns)


def build_spread(domestic: DataFrame, offshore: DataFrame, fx: DataFrame) -> DataFrame:
    """The spread panel: domestic (contract, dt, expiry, price, ...) with offshore (dt, expiry, cbot) and fx (dt, rate).

    Equi-joins; whether a side is broadcast is left to its measured size. Two offshore rows of one date and expiry are an error,
    as they would double the panel's.
    """
    joined = positive_legs(domestic.join(unique(offshore, "dt", "expiry"), ["dt", "expiry"]).join(fx, "dt"), "price", "cbot", "rate")
    usd = F.col("price") / F.col("rate")
    return joined.withColumns({"usd": usd, "spread": usd - F.col("cbot"), "log_usd": F.log(usd), "log_zar": F.log("price"), "log_cbot": F.log("cbot"), "log_spread": F.log(usd) - F.log("cbot")})


def exact_hour_snap(df: DataFrame, ts: str, value: str, hour: int) -> DataFrame:
    """dt, value: the first value within the hour of each date, by time; dates without one are absent."""
    return df.filter(F.hour(ts) == hour).groupBy(F.to_date(ts).alias("dt")).agg(F.min_by(value, F.struct(ts, value)).alias(value))


def quote_direction(fx: DataFrame, rate: str, low: float = 5.0, high: float = 30.0) -> DataFrame:
    """fx itself, failing at run time if the median rate lies outside (low, high): quoted the wrong way round."""
    ok = fx.agg(F.median(rate).alias("m")).select(F.assert_true((F.col("m") > low) & (F.col("m") < high), "the median rate is out of range").alias("_ok"))
    return fx.join(F.broadcast(ok), F.col("_ok").isNull(), "left_semi")


def outright_symbols(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Rows of single contracts: a product, a month code, a digit; spreads and butterflies go."""
    return df.filter(F.col(symbol).rlike(rf"^ZC([{''.join(MONTH_CODES)}])(\d)$"))


def resolve_expiry(symbol: Column, last_seen: Column, first_year: int = 2000, last_year: int = 2060, required: bool = False) -> Column:
    """yyyy-MM of a symbol with a one-digit year: the earliest delivery month at or after the month of its last print.

    Where no year fits: null, or an error at run time if required.
    """
    month = F.create_map(*[F.lit(x) for kv in MONTH_CODES.items() for x in kv])[F.substring(symbol, 3, 1)]
    digit = F.substring(symbol, 4, 1).cast("int")
    fits = F.filter(F.sequence(F.lit(first_year), F.lit(last_year)), lambda y: (y % 10 == digit) & (y * 12 + month >= F.year(last_seen) * 12 + F.month(last_seen)))
    none = F.raise_error(F.concat(F.lit("no delivery year fits "), symbol)).cast("string") if required else F.lit(None).cast("string")
    return F.when(F.size(fits) > 0, F.concat_ws("-", F.array_min(fits).cast("string"), F.lpad(month.cast("string"), 2, "0"))).otherwise(none)


def snap_before(df: DataFrame, key: str, ts: str, value: str, cutoff_hour: int = 11, reference_hour: int = 10, max_staleness_hours: float = 30) -> DataFrame:
    """key, dt, value, staleness_hours: each date's last print before the cut-off hour, carried over dates without one.

    Prints at or after the cut-off never count, not even on the next date. Staleness runs from the carried print to the
    reference hour of the date, so it can be below 0; rows staler than allowed go. volume-like columns are not carried.
    """
    prints = df.filter(F.hour(ts) < cutoff_hour).groupBy(key, F.to_date(ts).alias("dt")).agg(F.max(F.struct(ts, value)).alias("p"))
    span = prints.groupBy(key).agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    calendar = span.select(key, F.explode(F.sequence("a", "b")).alias("dt"))
    filled = calendar.join(prints, [key, "dt"], "left").withColumn("p", fill_forward(F.col("p"), over(key, "dt")))
    hours = (F.unix_micros(F.to_timestamp(F.col("dt"))) / 3.6e9 + reference_hour) - F.unix_micros(F.to_timestamp(F.col("p")[ts])) / 3.6e9
    return filled.select(key, "dt", F.col("p")[value].alias(value), hours.alias("staleness_hours")).filter(F.col("staleness_hours") <= max_staleness_hours)


def keep_first(df: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """One row for each key, the least by the rank columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*rank, *[c for c in rest if c not in rank])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def two_grades(panel: DataFrame, one: str, other: str, value: str = "price") -> DataFrame:
    """dt, expiry and the difference of two contracts, with a 10-row z-score and the change within the expiry."""
    from ..functions.rolling import zscore

    a, b = (panel.filter(F.col("contract") == c).select("dt", "expiry", F.col(value).alias(n)) for c, n in ((one, "one"), (other, "other")))
    w = over("expiry", "dt")
    d = a.join(b, ["dt", "expiry"]).withColumn("grade_spread", F.col("one") - F.col("other"))
    return d.withColumns({"grade_z": zscore(F.col("grade_spread"), w, 10), "grade_change": F.col("grade_spread") - F.lag("grade_spread").over(w)})
