"""Econometrics of series: unit roots, cointegration, autocorrelation, autoregression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import adf, coint
from ..functions.ordered import in_blocks
from ..functions.special import chi2_sf
from ..functions.storage import materialize


def adf_by_key(df: DataFrame, key: str, order: str, x: str, least_rows: int = 150) -> DataFrame:
    """key, stat, p, lags, nobs of each series with enough rows; constant series are absent. One series is one task's group."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        v = t.sort_values(order)[x].to_numpy()
        got = adf(v) if len(v) >= least_rows else None
        return pd.DataFrame([(t[key].iloc[0], *got)] if got else [], columns=[key, "stat", "p", "lags", "nobs"])

    return df.select(key, order, F.col(x).cast("double")).filter(F.col(x).isNotNull()).groupBy(key).applyInPandas(run, f"{key} string, stat double, p double, lags int, nobs int")


def coint_by_key(df: DataFrame, key: str, order: str, y: str, x: str, least_rows: int = 150) -> DataFrame:
    """key, stat, p of the residual test; rows without both legs do not count."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        got = coint(t[y].to_numpy(), t[x].to_numpy()) if len(t) >= least_rows else None
        return pd.DataFrame([(t[key].iloc[0], *got)] if got else [], columns=[key, "stat", "p"])

    return df.select(key, order, y, x).na.drop().groupBy(key).applyInPandas(run, f"{key} string, stat double, p double")


def fisher(df: DataFrame, p: str) -> DataFrame:
    """n, stat and the p-value of all p-values combined: an even number of degrees makes the tail a finite sum."""
    total = df.agg(F.count(p).alias("n"), F.sum(-2 * F.log(F.greatest(F.col(p), F.lit(1e-10)))).alias("stat"))
    h = F.col("stat") / 2
    log_terms = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda k: F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(h)) - F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double"))))
    return total.withColumn("p", F.when(F.col("n") > 0, F.aggregate(log_terms, F.lit(0.0), lambda s, v: s + F.exp(v - h))))


def engle_granger(df: DataFrame, key: str, y: str, x: str, least_rows: int = 3) -> DataFrame:
    """key, alpha, beta, r2, n of y on x for each key."""
    return df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(key).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)


def residuals(df: DataFrame, fits: DataFrame, key: str, y: str, x: str) -> DataFrame:
    return df.join(fits.select(key, "alpha", "beta"), key).withColumn("residual", F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)).drop("alpha", "beta")


def autocorrelation(df: DataFrame, series: str, order: str, x: str, lags: int) -> DataFrame:
    """series, lag, rho, n: sample autocorrelations of the values that are present, in order."""
    w = Window.partitionBy(series, "_block").orderBy(order)
    d = df.filter(F.col(x).isNotNull()).select(series, order, x)
    d = in_blocks(d, [series], order, lags).join(d.groupBy(series).agg(F.avg(x).alias("_mean")), series).withColumn("_e", F.col(x) - F.col("_mean"))
    d = d.withColumns({f"_{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)}).filter("_own")
    sums = d.groupBy(series).agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_v"), F.array(*[F.sum(F.col("_e") * F.col(f"_{k}")) for k in range(1, lags + 1)]).alias("_c"))
    return sums.select(series, "n", "_v", F.posexplode("_c").alias("_p", "_x")).filter(F.col("n") > F.col("_p") + 1).select(series, (F.col("_p") + 1).alias("lag"), (F.col("_x") / F.nullif(F.col("_v"), F.lit(0.0))).alias("rho"), "n")


def ljung_box(df: DataFrame, series: str, order: str, x: str, lags: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """series, lags, q, n: the portmanteau statistic up to each lag."""
    a = autocorrelation(df, series, order, x, max(lags))
    each = a.withColumn("lags", F.explode(F.array(*[F.lit(k) for k in lags]))).filter("lag <= lags")
    return each.groupBy(series, "lags").agg((F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))) * F.first("n") * (F.first("n") + 2)).alias("q"), F.first("n").alias("n"))


def ljung_box_p(q: DataFrame) -> DataFrame:
    """q with its upper tail; a few rows a series."""
    p = F.pandas_udf(lambda v, k: pd.Series([None if x != x else chi2_sf(x, int(n)) for x, n in zip(v, k, strict=True)], dtype=float), "double")
    return q.withColumn("p", p("q", "lags"))


def white_noise(df: DataFrame, series: str, order: str, x: str, lags: tuple[int, ...] = (5, 10, 20), plot_lags: int = 60) -> DataFrame:
    """Per series and lags: q and p of the values and of their squares, whether all p of the values exceed 5 %, the band of the
    autocorrelations, how many of the first plot_lags (at most half of the rows) lie outside it and how many would by chance."""
    both = df.withColumn("_x2", F.col(x) * F.col(x))
    level = ljung_box_p(ljung_box(both, series, order, x, lags))
    squared = ljung_box_p(ljung_box(both, series, order, "_x2", lags)).select(series, "lags", F.col("q").alias("q_squared"), F.col("p").alias("p_squared"))
    rho = autocorrelation(df, series, order, x, plot_lags).filter(F.col("lag") <= F.floor(F.col("n") / 2))
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    outside = rho.groupBy(series).agg(F.first(band).alias("band"), F.sum((F.abs("rho") > band).cast("long")).alias("n_outside"), (F.count("*") * 0.05).alias("expected_outside"))
    return level.join(squared, [series, "lags"]).join(outside, series).withColumn("white_noise", F.min("p").over(Window.partitionBy(series)) > 0.05)


def correlogram(df: DataFrame, series: str, order: str, x: str, lags: int = 60) -> DataFrame:
    """series, lag, rho, partial: autocorrelations and, by the Levinson recursion over a series' few lags, partial ones."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("lag")
        return t[[series, "lag", "rho"]].assign(partial=partial_autocorrelation(t["rho"].tolist()))

    return autocorrelation(df, series, order, x, lags).groupBy(series).applyInPandas(run, f"{series} string, lag int, rho double, partial double")


def partial_autocorrelation(rho: list[float]) -> list[float]:
    """Partial autocorrelations from the first autocorrelations, by the Levinson recursion. For tens of lags."""
    out, phi = [], []
    for k, r in enumerate(rho):
        top = r - sum(phi[j] * rho[k - 1 - j] for j in range(k))
        low = 1 - sum(phi[j] * rho[j] for j in range(k))
        a = top / low if low else math.nan
        phi = [phi[j] - a * phi[k - 1 - j] for j in range(k)] + [a]
        out.append(a)
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """The pseudo-inverse of a matrix of products, each column at unit length, so that no column is cut for its unit."""
    size = np.sqrt(np.diag(a))
    size = np.outer(*2 * [np.where(size > 0, size, 1)])
    return np.linalg.pinv(a / size, hermitian=True) / size


def autoregression(df: DataFrame, series: str, order: str, x: str, lags: int) -> DataFrame:
    """series, term, coef, se: least squares of x on a constant and its own lags, from sums that combine before the shuffle.

    The sums are of x less its mean, and not of x: of a level far from 0 the products keep too few digits of the
    deviations. The constant and its deviation are then those of x itself. Lags of a constant series get 0.
    """
    w = Window.partitionBy(series, "_block").orderBy(order)
    terms = ["_1", *[f"_x{k}" for k in range(1, lags + 1)]]
    value = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    rows = materialize(df.select(series, order, value.alias("_x")), "autoregression")
    mean = rows.groupBy(series).agg(F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.avg("_x")).alias("_mean"))
    d = in_blocks(rows, [series], order, lags).join(mean, series).withColumn("_y", F.col("_x") - F.col("_mean"))
    d = d.withColumns({"_1": F.lit(1.0), **{f"_x{k}": F.lag("_y", k).over(w) for k in range(1, lags + 1)}}).filter("_own").select(series, "_mean", "_y", *terms).na.drop()
    columns = [*terms, "_y"]
    sums = d.groupBy(series, "_mean").agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in columns for b in columns]).alias("_s"), F.count("*").alias("_n"))

    def solve(batches):
        for t in batches:
            rows = []
            for name, mean, s, n in zip(t[series], t["_mean"], t["_s"], t["_n"], strict=True):
                m = np.array(s).reshape(len(columns), len(columns))
                inv = _inverse(m[:-1, :-1])
                beta = inv @ m[:-1, -1]
                s2 = max(m[-1, -1] - beta @ m[:-1, -1], 0) / max(n - len(terms), 1)
                back = np.eye(len(terms))
                back[0, 1:] = -mean
                inv, beta = back @ inv @ back.T, back @ beta + np.where(np.arange(len(terms)) == 0, mean, 0)
                rows += [(name, "const" if k == 0 else f"lag{k}", float(b), float(np.sqrt(max(inv[k, k] * s2, 0)))) for k, b in enumerate(beta)]
            yield pd.DataFrame(rows, columns=[series, "term", "coef", "se"])

    return sums.mapInPandas(solve, f"{series} string, term string, coef double, se double")


def hac_regression(df: DataFrame, key: str, order: str, y: str, xs: tuple[str, ...], lags: int) -> DataFrame:
    """key, term, coef, t of a regression with a constant and Bartlett-weighted covariances; rows with a null are left out first.

    Rows only go into sums: the normal equations first, then the products of the scores and their lags, taken within blocks
    of time. A key's few sums are solved in one task.
    """
    terms = ["const", *xs]
    value = {"const": F.lit(1.0), **{c: F.col(c).cast("double") for c in xs}}
    rows = materialize(df.select(key, order, F.col(y).cast("double").alias("_y"), *[value[c].alias(c) for c in xs]).na.drop(), "regression")
    m = len(terms)
    squares = [F.sum(value[terms[i]] * value[terms[j]]).alias(f"_a{i}_{j}") for i in range(m) for j in range(i, m)]
    sums = rows.groupBy(key).agg(*squares, *[F.sum(value[c] * F.col("_y")).alias(f"_c{i}") for i, c in enumerate(terms)])

    def matrix(r, name: str) -> np.ndarray:
        return np.array([[r[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], dtype=float)

    def solve(batches):
        for t in batches:
            rows = []
            for _, r in t.iterrows():
                inv = _inverse(matrix(r, "_a"))
                rows.append((r[key], (inv @ [r[f"_c{i}"] for i in range(m)]).tolist(), inv.ravel().tolist()))
            yield pd.DataFrame(rows, columns=[key, "_beta", "_inv"])

    solved = materialize(sums.mapInPandas(solve, f"{key} string, _beta array<double>, _inv array<double>"), "solved")
    e = F.col("_y") - sum((F.col("_beta")[i] * value[c] for i, c in enumerate(terms)), F.lit(0.0))
    scored = rows.join(solved.select(key, "_beta"), key).withColumn("_e", e).select(key, order, *[(F.col("_e") * value[c]).alias(f"_u{i}") for i, c in enumerate(terms)])
    w = Window.partitionBy(key, "_block").orderBy(order)
    past = {f"_u{i}_{k}": F.lag(f"_u{i}", k).over(w) for i in range(m) for k in range(1, lags + 1)}
    laid = in_blocks(scored, [key], order, lags).withColumns(past).filter("_own")
    u = lambda i, k=0: F.col(f"_u{i}_{k}" if k else f"_u{i}")
    cell = lambda i, j: F.sum(u(i) * u(j)) + sum((F.coalesce(F.sum(u(i) * u(j, k)) + F.sum(u(i, k) * u(j)), F.lit(0.0)) * (1 - k / (lags + 1)) for k in range(1, lags + 1)), F.lit(0.0))
    meat = laid.groupBy(key).agg(*[cell(i, j).alias(f"_m{i}_{j}") for i in range(m) for j in range(i, m)])

    def finish(batches):
        for t in batches:
            rows = []
            for _, r in t.iterrows():
                inv = np.array(r["_inv"]).reshape(m, m)
                se = np.sqrt(np.maximum(np.diag(inv @ matrix(r, "_m") @ inv), 1e-300))
                rows += [(r[key], c, float(b), float(b / s)) for c, b, s in zip(terms, r["_beta"], se, strict=True)]
            yield pd.DataFrame(rows, columns=[key, "term", "coef", "t"])

    return solved.join(meat, key).mapInPandas(finish, f"{key} string, term string, coef double, t double")
