"""Trading statistics and walk-forward folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rolling as R


def equity(df: DataFrame, key: list[str], order: str, ret: str) -> DataFrame:
    """df with equity (running product of 1 + return) and drawdown from its peak so far."""
    w = R.over(key, order)
    df = df.withColumn("equity", F.product(1 + F.col(ret)).over(R.expanding(w)))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(R.expanding(w)) - 1)


def trade_stats(df: DataFrame, key: list[str], order: str, ret: str, periods: float) -> DataFrame:
    """Thirteen statistics of the returns of each key. The peak starts at the first trade; a deviation of 0 gives null."""
    e = equity(df.filter(F.col(ret).isNotNull()), key, order, ret)
    r = F.col(ret)
    n, sd = F.count("*").cast("double"), F.stddev_samp(r)
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))))
    total = F.product(1 + r) - 1
    annual = F.when(F.product(1 + r) > 0, F.pow(F.product(1 + r), periods / n) - 1)
    return e.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("ev"), F.median(r).alias("median"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"),
        total.alias("total"), annual.alias("annual"), F.min("drawdown").alias("max_drawdown"), (F.avg(r) / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods)).alias("sharpe"),
        (F.avg(r) / F.nullif(down, F.lit(0.0)) * math.sqrt(periods)).alias("sortino"), (F.avg(r) / F.nullif(sd, F.lit(0.0)) * F.sqrt(n)).alias("t"),
    ).withColumn("calmar", F.col("annual") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))


def performance(df: DataFrame, series: str, order: str, signal: str, forward: str, horizon: int, periods: float = 252) -> DataFrame:
    """Statistics of sign(signal) * forward taken every horizon rows, for each start offset, averaged over offsets.

    A signal of 0 earns nothing and counts as a trade.
    """
    w = R.over(series, order)
    traded = df.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull()).withColumn("pnl", F.signum(F.col(signal)) * F.col(forward)).withColumn("offset", (F.row_number().over(w) - 1) % horizon)
    each = trade_stats(traded, [series, "offset"], order, "pnl", periods / horizon)
    mean = [c for c in each.columns if c not in (series, "offset", "n")]
    return each.groupBy(series).agg(F.count("*").alias("n_offsets"), F.avg("n").alias("n"), *[F.avg(c).alias(c) for c in mean], F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"))


def sharpe(df: DataFrame, key: str, ret: str, periods: int = 252) -> DataFrame:
    """Mean, deviation, annual return, volatility and Sharpe ratio; the ratio of a constant is 0."""
    sd = F.stddev_samp(ret)
    p = F.product(1 + F.col(ret))
    return df.groupBy(key).agg(F.avg(ret).alias("mean"), sd.alias("std"), F.when(p > 0, F.pow(p, periods / F.count(ret)) - 1).alias("annual_return"), (sd * math.sqrt(periods)).alias("annual_vol"), F.coalesce(F.avg(ret) / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods), F.lit(0.0)).alias("sharpe"))


def sharpe_summary(df: DataFrame, ret: str, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """One row: sharpe (null for a constant), mean_period, std_period, ann_return, ann_vol, n of the excess over the risk-free rate.

    The query fails if no row has a value.
    """
    x = F.col(ret) - risk_free / periods
    mean, sd = F.avg(x), F.stddev_samp(x)
    n = F.when(F.count(x) > 0, F.count(x)).otherwise(F.raise_error(F.lit(f"{ret} has no values")).cast("long"))
    return df.agg((mean / F.when(sd > 0, sd) * math.sqrt(periods)).alias("sharpe"), mean.alias("mean_period"), sd.alias("std_period"), (mean * periods).alias("ann_return"), (sd * math.sqrt(periods)).alias("ann_vol"), n.alias("n"))


def simple_returns(df: DataFrame, pnl: str, notional: str | None = None, log_returns: bool = False, out: str = "ret") -> DataFrame:
    x = F.col(pnl)
    return df.withColumn(out, F.expm1(x) if log_returns else R.ratio(x, F.col(notional)) if notional else x)


def walk_forward_folds(n_rows: int, n_splits: int, test_size: int, embargo: int, min_test_start: int = 0, min_train: int = 250) -> list[tuple[int, int, int, int]]:
    """(fold, rows before which training ends, first test row, row after the last): expanding, the last test ends at the end."""
    out = []
    for k in range(n_splits):
        start = n_rows - (n_splits - k) * test_size
        if start >= max(min_test_start, 0) and start - embargo >= min_train:
            out.append((len(out), start - embargo, start, start + test_size))
    return out


def fold_table(spark: SparkSession, df: DataFrame, order: str, folds: list[tuple[int, int, int, int]]) -> DataFrame:
    """Dates and sizes of each fold, by a range join of the folds with row numbers."""
    rows = df.withColumn("row", F.row_number().over(Window.partitionBy("series").orderBy(order)) - 1)
    f = spark.createDataFrame(folds, "fold int, train_end_row int, test_start_row int, test_end_row int")
    both = rows.join(F.broadcast(f), F.col("row") < F.col("test_end_row"))
    train, test = F.col("row") < F.col("train_end_row"), F.col("row") >= F.col("test_start_row")
    return both.groupBy("series", "fold").agg(F.max(F.when(train, F.col(order))).alias("train_end"), F.min(F.when(test, F.col(order))).alias("test_start"), F.max(F.when(test, F.col(order))).alias("test_end"), F.sum(train.cast("long")).alias("n_train"), F.sum(test.cast("long")).alias("n_test"))
