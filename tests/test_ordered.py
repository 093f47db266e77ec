"""Ranks, blocks of time and quantiles that spread over tasks, against pandas, with blocks far smaller than the series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termgrid.functions import ordered as O
from termgrid.functions import rolling as R


@pytest.fixture(scope="module")
def frame(spark):
    """Two series with ties, gaps and missing values, one of them with a value that a third of its rows share; an int order and a date."""
    rng, rows = np.random.default_rng(5), []
    for name, n in (("a", 900), ("b", 350)):
        x = np.round(np.cumsum(rng.normal(size=n)), 1)
        x[rng.random(n) < 0.05] = np.nan
        x[rng.random(n) < 0.3] = 2.5
        day, gaps = 0, rng.choice([1, 1, 1, 4, 90], n, p=[0.4, 0.3, 0.2, 0.09, 0.01])
        for i in range(n):
            day += int(gaps[i])
            rows.append((name, i, dt.date(2000, 1, 1) + dt.timedelta(day), None if x[i] != x[i] else float(x[i])))
    pdf = pd.DataFrame(rows, columns=["s", "t", "day", "x"])
    return pdf, spark.createDataFrame(rows, "s string, t int, day date, x double").repartition(5, "x").cache()


def by_row(df, c):
    return df.select("s", "t", c).toPandas().sort_values(["s", "t"])[c].to_numpy(dtype=float)


@pytest.mark.parametrize("order", ["t", "day"])
@pytest.mark.parametrize(("n", "least", "rows"), [(15, None, 20), (60, 7, 50), (200, 30, 40), (15, None, 100_000)])
def test_trailing_rank_is_that_of_pandas(frame, order, n, least, rows):
    pdf, df = frame
    got = O.trailing_rank(df, "s", order, "x", "r", n, least, rows)
    want = pdf.groupby("s").x.transform(lambda v: v.rolling(n, min_periods=least or n).rank(pct=True)).where(pdf.x.notna())
    assert got.columns == [*df.columns, "r"] and got.count() == len(pdf)
    np.testing.assert_allclose(by_row(got, "r"), want, rtol=1e-12)


@pytest.mark.parametrize(("order", "rows"), [("t", 50), ("day", 30), ("t", 100_000)])
def test_expanding_rank_is_that_of_pandas(frame, order, rows):
    pdf, df = frame
    got = O.expanding_rank(df, "s", order, "x", "r", 20, rows)
    want = pdf.groupby("s").x.transform(lambda v: v.expanding(20).rank(pct=True)).where(pdf.x.notna())
    assert got.columns == [*df.columns, "r"]
    np.testing.assert_allclose(by_row(got, "r"), want, rtol=1e-12)


@pytest.mark.parametrize(("order", "rows"), [("t", 50), ("day", 40), ("t", 100_000)])
def test_ewm_is_that_of_pandas(frame, order, rows):
    pdf, df = frame
    got = O.ewm_means(df, "s", order, "x", {"fast": 5, "slow": 120}, rows)
    for c, span in (("fast", 5), ("slow", 120)):
        want = pdf.groupby("s").x.transform(lambda v: v.ewm(span=span, ignore_na=True).mean())
        np.testing.assert_allclose(by_row(got, c), want, rtol=1e-12, atol=1e-12)


def test_ranks_merge_ties_at_the_edges_of_ranges(frame, spark):
    pdf, df = frame
    some = df.filter("x is not null")
    got = O.weigh(some, ["s"], "x", ["t"])
    seen = pdf[pdf.x.notna()]
    np.testing.assert_allclose(by_row(got, "less"), seen.groupby("s").x.rank(method="min") - 1)
    np.testing.assert_allclose(by_row(got, "same"), seen.groupby(["s", "x"]).x.transform("size"))
    heavy = O.weigh(some, ["s"], "x", ["t"], F.col("t"))
    at = lambda r: seen[(seen.s == r.s) & (seen.x < r.x)].t.sum()
    assert all(r.less == at(r) for r in heavy.filter("t % 50 = 0").collect())


def test_a_value_of_most_rows_spreads_over_ranges(spark):
    df = spark.range(4000).select(F.lit("k").alias("s"), F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / 1000).alias("x"), "id")
    got = O.weigh(df, ["s"], "x", ["id"])
    assert {(r.less, r.same) for r in got.filter("x = 1.0").select("less", "same").distinct().collect()} == {(100, 3601)}
    assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("shares", [(0.5,), (0.0, 0.1, 0.37, 0.9, 1.0)])
def test_quantiles_are_those_of_pandas(frame, shares):
    pdf, df = frame
    got = {r.s: r.q for r in O.quantiles(df, ["s"], "x", shares).collect()}
    for name, v in pdf.groupby("s").x:
        np.testing.assert_allclose(got[name], v.quantile(list(shares)), rtol=1e-12)


def test_quantiles_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None)], "s string, x double")
    assert {r.s: r.q for r in O.quantiles(df, ["s"], "x", (0.1, 0.5)).collect()} == {"a": [2.0, 2.0]}


def test_earlier_counts():
    v = np.random.default_rng(0).integers(0, 9, 300).astype(float)
    less, same = O.earlier(v)
    assert all((less[i], same[i]) == ((v[:i] < v[i]).sum(), (v[:i] == v[i]).sum()) for i in range(300))
    assert [len(x) for x in O.earlier(np.empty(0))] == [0, 0]


def test_every_window_finds_its_halo(frame):
    """A rolling mean within blocks and their halo is that over the series."""
    pdf, df = frame
    w = R.over(["s", "_block"], "day")
    got = O.in_blocks(df, ["s"], "day", 9, 12).withColumn("m", R.rolling(F.avg, F.col("x"), w, 10, 1)).filter("_own")
    assert got.select("_block").distinct().count() > 10
    np.testing.assert_allclose(by_row(got, "m"), pdf.groupby("s").x.transform(lambda v: v.rolling(10, min_periods=1).mean()), rtol=1e-9)
