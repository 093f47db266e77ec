"""Aggregations that describe frames, series and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.ordered import quantiles


def sample_skew(x: str) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def moments(df: DataFrame, key: list[str], x: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurt"))


def distribution(df: DataFrame, key: Column, x: str) -> DataFrame:
    return df.groupBy(key.alias("bucket")).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))


def year_by_month(df: DataFrame, series: str, dt: str, x: str) -> DataFrame:
    """Mean by series and year, a column for each month."""
    return df.groupBy(series, F.year(dt).alias("year")).agg(*[F.avg(F.when(F.month(dt) == m, F.col(x))).alias(f"m{m}") for m in range(1, 13)])


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n and the share of the row's total, in long form."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.join(n.groupBy(row).agg(F.sum("n").alias("_t")), row).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def frame_profile(df: DataFrame, numeric: tuple[str, ...], others: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column: n, nulls, distinct, min, mean, max."""
    parts = []
    for c in (*numeric, *others):
        num = c in numeric
        none = F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), (F.count("*") - F.count(c)).alias("nulls"), F.count_distinct(c).alias("distinct"), (F.min(c).cast("double") if num else none).alias("min"), (F.avg(c) if num else none).alias("mean"), (F.max(c).cast("double") if num else none).alias("max")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def date_steps(df: DataFrame, series: str, dt: str) -> DataFrame:
    """Per series: first and last date, the most frequent step in days (ties to the least), and how many steps exceed it."""
    d = df.select(series, dt).distinct().withColumn("step", F.datediff(F.col(dt), F.lag(dt).over(R.over(series, dt))))
    count = d.filter("step is not null").groupBy(series, "step").agg(F.count("*").alias("c"))
    mode = count.groupBy(series).agg(F.min_by("step", F.struct(-F.col("c"), "step")).alias("modal_step"))
    span = df.groupBy(series).agg(F.min(dt).alias("first_dt"), F.max(dt).alias("last_dt"), F.count("*").alias("n"))
    gaps = count.join(mode, series).groupBy(series, "modal_step").agg(F.sum(F.when(F.col("step") > F.col("modal_step"), F.col("c")).otherwise(0)).alias("n_gaps"))
    return span.join(gaps, series)


def weekly(df: DataFrame, series: str, dt: str, x: str) -> DataFrame:
    """Sums by weeks that end on Friday; a week of nulls only is left out."""
    end = F.next_day(F.date_sub(dt, 1), "FRI").alias("week_end")
    return df.groupBy(series, end).agg(F.sum(x).alias(x)).filter(F.col(x).isNotNull())


def spells(df: DataFrame, series: str, dt: str, label: str) -> DataFrame:
    """series, label, spell, length: runs of equal labels in order of time."""
    w = R.over(series, dt)
    change = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    df = df.withColumn("_c", change).withColumn("spell", F.sum("_c").over(R.expanding(w)))
    return df.groupBy(series, "spell", label).agg(F.count("*").alias("length"))


def persistence(df: DataFrame, series: str, dt: str, label: str) -> DataFrame:
    """Per label: spells, their mean, median and largest length, and the share of rows."""
    s = spells(df, series, dt, label)
    per = s.groupBy(series, label).agg(F.count("*").alias("n_spells"), F.avg("length").alias("mean_length"), F.median("length").alias("median_length"), F.max("length").alias("max_length"), F.sum("length").alias("_n"))
    total = s.groupBy(series).agg(F.sum("length").alias("_t"), ((F.count("*") - 1) / F.nullif(F.sum("length") - 1, F.lit(0))).alias("switch_rate"))
    return per.join(total, series).withColumn("occupancy", F.col("_n") / F.col("_t")).drop("_n", "_t")


def gap_report(df: DataFrame, series: str, dt: str, x: str) -> DataFrame:
    """Per series: rows, missing ones, their share, and the longest distance between missing rows or the ends."""
    w = R.over(series, dt)
    d = df.withColumn("_r", F.row_number().over(w))
    n = d.groupBy(series).agg(F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("n_gaps"))
    edges = d.filter(F.col(x).isNull()).select(series, F.col("_r").cast("long").alias("_r")).unionByName(n.select(series, F.lit(0).cast("long").alias("_r"))).unionByName(n.select(series, (F.col("n") + 1).alias("_r")))
    longest = edges.withColumn("_d", F.col("_r") - F.lag("_r").over(R.over(series, "_r"))).groupBy(series).agg(F.max("_d").alias("longest_clean"))
    return n.join(longest, series).withColumn("gap_share", F.col("n_gaps") / F.col("n"))


def histogram(df: DataFrame, x: str, bins: int, series: str) -> DataFrame:
    """series, bin (from 0) and n: equal widths between a series' least and greatest value, which belongs to the last bin."""
    ends = df.groupBy(series).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    b = F.least(F.floor((F.col(x) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.filter(F.col(x).isNotNull()).join(ends, series).groupBy(series, F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ohlcv_wide(df: DataFrame, dt: str, name: str, names: list[str], fields: tuple[str, ...]) -> DataFrame:
    """One row a date, a column <name>_<field> for each pair."""
    return df.groupBy(dt).agg(*[F.first(F.when(F.col(name) == n, F.col(f)), ignorenulls=True).alias(f"{n}_{f}") for n in names for f in fields])


def quantile_buckets(df: DataFrame, x: str, n: int, by: str | None = None) -> DataFrame:
    """df with bucket Q1..Qn of x by linearly interpolated edges, right-closed, the least value included; ties stay together."""
    one = by or "_one"
    df = df if by else df.withColumn(one, F.lit(0))
    df = df.join(quantiles(df, [one], x, tuple(k / n for k in range(1, n))).withColumnRenamed("q", "_e"), one, "left")
    place = F.size(F.filter("_e", lambda e: e < F.col(x))) + 1
    return df.withColumn("bucket", F.when(F.col(x).isNotNull(), F.concat(F.lit("Q"), place.cast("string")))).drop("_e", "_one")


def conditional_response(df: DataFrame, key: list[str], level: str, change: str, forward: str, horizon: int, threshold: float) -> DataFrame:
    """Per key: mean level, forward mean, deviation, overlap-adjusted t, 10th and 90th percentile, shares beyond the threshold."""
    f = F.col(forward)
    n, sd = F.count(f), F.stddev_samp(f)
    df = df.na.drop(subset=key)
    tails = quantiles(df, key, forward, (0.1, 0.9)).select(*key, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))
    return df.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(level).alias("level_mean"), F.corr(level, change).alias("level_change_corr"), F.avg(f).alias("fwd_mean"), sd.alias("fwd_sd"),
        (F.avg(f) / F.nullif(sd, F.lit(0.0)) * F.sqrt(n.cast("double")) / F.sqrt(F.lit(float(horizon)))).alias("t_adj"),
        F.avg((f > threshold).cast("double")).alias("share_above"), F.avg((f < -threshold).cast("double")).alias("share_below"), F.max(f).alias("fwd_max"), F.min(f).alias("fwd_min"),
    ).join(tails, key, "left")


def regime_profile(df: DataFrame, label: str, ret: str, dt: str, series: str, periods: int = 252) -> DataFrame:
    """Per label: rows, share, annual return, volatility, Sharpe, hit rate, corrected moments and the drawdown of its own rows."""
    w = R.over([series, label], dt)
    df = df.withColumn("_eq", F.exp(F.sum(ret).over(R.expanding(w)))).withColumn("_dd", F.col("_eq") / F.max("_eq").over(R.expanding(w)) - 1)
    out = df.groupBy(series, label).agg(F.count("*").alias("n"), (F.avg(ret) * periods).alias("ann_ret"), (F.stddev_samp(ret) * periods**0.5).alias("ann_vol"), (F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0)) * periods**0.5).alias("sharpe"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), sample_skew(ret).alias("skew"), sample_kurtosis(ret).alias("kurt"), F.min("_dd").alias("max_drawdown"))
    total = out.groupBy(series).agg(F.sum("n").alias("_t"))
    return out.join(total, series).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def leg_response(df: DataFrame, key: list[str], change: str, one: str, other: str, periods: int = 252) -> DataFrame:
    """Per key: rows, both legs' annual drift in per cent, and the three correlations of the change and the legs."""
    drift = lambda leg: (F.avg(leg) * periods * 100).alias(f"{leg}_ann_pct")
    return df.groupBy(*key).agg(F.count("*").alias("n"), drift(one), drift(other), F.corr(change, one).alias(f"corr_change_{one}"), F.corr(change, other).alias(f"corr_change_{other}"), F.corr(one, other).alias("corr_legs"))


def forward_by_label(df: DataFrame, series: str, dt: str, label: str, ret: str, horizons: tuple[int, ...] = (1, 5, 10, 20), features: tuple[str, ...] = ()) -> DataFrame:
    """Per series and label: mean and t of the sum of the next h rows from this one on, for each h, and the features' means."""
    w = R.over(series, dt)
    df = df.withColumns({f"_f{h}": R.forward_sum(F.col(ret), w, h) for h in horizons})
    t = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * F.sqrt(F.count(c).cast("double"))
    return df.groupBy(series, label).agg(F.count("*").alias("n"), *[x for h in horizons for x in (F.avg(f"_f{h}").alias(f"fwd_{h}_mean"), t(f"_f{h}").alias(f"fwd_{h}_t"))], *[F.avg(c).alias(f"mean_{c}") for c in features])


def occupancy(df: DataFrame, series: str, dt: str, label: str) -> DataFrame:
    """series, unit, value, label, n, share: how the labels divide each calendar month and each year."""
    unit = F.explode(F.array(F.struct(F.lit("month").alias("unit"), F.month(dt).alias("value")), F.struct(F.lit("year").alias("unit"), F.year(dt).alias("value"))))
    n = df.select(series, label, unit.alias("u")).groupBy(series, "u.unit", "u.value", label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(series, "unit", "value")))


def describe(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Per key and column: n, mean, std, min, quartiles, max."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], list(columns), "column", "x")
    out = long.groupBy(key, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(quantiles(long, [key, "column"], "x", (0.25, 0.5, 0.75)), [key, "column"], "left")
    return out.select(key, "column", "n", "mean", "std", "min", *[F.col("q")[k].alias(f"q{q}") for k, q in enumerate((25, 50, 75))], "max")


def group_medians(df: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "_column", "_v")
    middle = quantiles(long, [*keys, "_column"], "_v", (0.5,))
    found = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == c, F.col("q")[0])).alias(f"{c}_median") for c in columns])
    return df.select(*keys).distinct().join(found, keys, "left")


def spread_by_key(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per key: rows, deviation and range of a column."""
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_samp(x).alias(f"{x}_std"), (F.max(x) - F.min(x)).alias(f"{x}_range"))


def build_report(df: DataFrame, key: str, dt: str, x: str, flag: Column) -> DataFrame:
    """One row: rows, keys, first and last date, median, flagged rows."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"), F.min(dt).alias("first_dt"), F.max(dt).alias("last_dt"), F.median(x).alias("median"), F.count_if(flag).alias("n_flagged"))


def holding_periods(df: DataFrame, series: str, dt: str, x: str, periods: tuple[int, ...], names: list[str]) -> DataFrame:
    """period, then a column for each series: the mean return over so many rows ahead."""
    w = R.over(series, dt)
    long = df.withColumns({f"_{h}": R.ratio(F.lead(x, h).over(w), F.col(x)) - 1 for h in periods}).select(series, F.explode(F.array(*[F.struct(F.lit(h).alias("period"), F.col(f"_{h}").alias("r")) for h in periods])).alias("p"))
    return long.groupBy("p.period").pivot(series, names).agg(F.avg("p.r"))


def prepare_returns(df: DataFrame, series: str, dt: str, x: str) -> DataFrame:
    """series, dt, the value with a missing one as 0, and is_gap."""
    return df.select(series, dt, F.coalesce(F.col(x), F.lit(0.0)).alias(x), F.col(x).isNull().alias("is_gap"))


def gap_dates(df: DataFrame, series: str, dt: str, x: str) -> DataFrame:
    return df.filter(F.col(x).isNull()).select(series, dt)


def flattened(df: DataFrame, dt: str, name: str, names: list[str], fields: tuple[str, ...]) -> DataFrame:
    """ohlcv_wide of some fields, without dates that lack any."""
    return ohlcv_wide(df, dt, name, names, fields).na.drop()


def worst_pair(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of pairs (a, b, rho) that with the largest absolute correlation, ties to the first by name; one for each of the keys."""
    best = pairs.filter("a <> b and rho is not null").groupBy(*(keys or [])).agg(F.min_by(F.struct("a", "b", "rho"), F.struct(-F.abs(F.round("rho", 9)), "a", "b")).alias("w"))
    return best.select(*(keys or []), "w.a", "w.b", "w.rho")
