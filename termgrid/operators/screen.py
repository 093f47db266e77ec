"""Factor screen: rank correlation, autocorrelation-robust t, decay, correlation matrix, pruning."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import in_blocks, weigh
from ..functions.storage import materialize
from ..functions.special import correlation_p, normal_two_sided


def long_form(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def average_rank(df: DataFrame, keys: tuple[str, ...], order: str, x: str, out: str) -> DataFrame:
    """Average-tie rank of x, which is not null, within the keys; rows are dealt out by ranges of x, not by key."""
    return weigh(df, list(keys), x, [order]).withColumn(out, F.col("less") + (F.col("same") + 1) / 2).drop("less", "same")


def rank_ic(df: DataFrame, key: str, order: str, features: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    """key, feature, target, ic, n: Spearman correlation over a key's rows that have both, ranked to 9 decimals."""
    pairs, g = _pairs(df, key, order, features, targets), (key, "feature", "target")
    ranked = average_rank(average_rank(pairs, g, order, "x", "rx"), g, order, "y", "ry")
    return ranked.groupBy(*g).agg(F.corr("rx", "ry").alias("ic"), F.count("*").alias("n"))


def _pairs(df: DataFrame, key: str, order: str, features: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    x = long_form(df.select(key, order, *targets, *[F.col(c).cast("double").alias(c) for c in features]), (key, order, *targets), features, "feature", "x")
    both = long_form(x, (key, order, "feature", "x"), targets, "target", "y")
    return both.filter("x is not null and y is not null").withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


def with_p(ic: DataFrame) -> DataFrame:
    """ic with the two-sided p of each correlation; a table of features by targets, not of rows."""
    p = F.pandas_udf(lambda rho, n: pd.Series([correlation_p(r, k) for r, k in zip(rho.where(rho.notna(), None), n, strict=True)], dtype=float), "double")
    return ic.withColumn("p", p("ic", F.col("n").cast("int")))


def with_normal_p(scores: DataFrame) -> DataFrame:
    """scores with the two-sided normal p of each t."""
    p = F.pandas_udf(lambda t: t.map(normal_two_sided, na_action="ignore").astype(float), "double")
    return scores.withColumn("p", p("t"))


def nw_t(df: DataFrame, key: str, order: str, features: tuple[str, ...], targets: tuple[str, ...], lags: int) -> DataFrame:
    """key, feature, target, slope, t, n: regression of standardised ranks with Bartlett weights on the lags' covariances.

    Lags count rows after those without a pair are dropped; no correction for small samples.
    """
    pairs = _pairs(df, key, order, features, targets)
    g = [key, "feature", "target"]
    ranked = materialize(average_rank(average_rank(pairs, g, order, "x", "rx"), g, order, "y", "ry"), "ranks")
    both = [x for r in ("rx", "ry") for x in (F.avg(r).alias(f"m{r}"), F.stddev_samp(r).alias(f"s{r}"))]
    e = ranked.join(ranked.groupBy(*g).agg(*both, F.corr("rx", "ry").alias("b")), g)
    e = e.withColumns({c: (F.col(r) - F.col(f"m{r}")) / F.nullif(F.col(f"s{r}"), F.lit(0.0)) for c, r in (("zx", "rx"), ("zy", "ry"))})
    e = e.select(*g, order, "zx", "b", ((F.col("zy") - F.col("b") * F.col("zx")) * F.col("zx")).alias("u"))
    o = Window.partitionBy(*g, "_block").orderBy(order)
    e = in_blocks(e, g, order, lags).withColumns({f"u{k}": F.lag("u", k).over(o) for k in range(1, lags + 1)}).filter("_own")
    # the mean of zx is 0, so the slope's part of the sandwich stands alone
    meat = sum((F.sum(F.col("u") * F.col(f"u{k}")) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)), F.sum(F.col("u") * F.col("u")))
    out = e.groupBy(*g).agg(F.first("b").alias("slope"), F.count("*").alias("n"), meat.alias("_m"), F.sum(F.col("zx") * F.col("zx")).alias("_s"))
    return out.select(*g, "slope", (F.col("slope") / F.when(F.col("_m") > 0, F.sqrt("_m") / F.col("_s"))).alias("t"), "n")


def bonferroni_bar(tests: int, level: float = 0.05) -> float:
    return abs(NormalDist().inv_cdf(level / 2 / tests))


def best_horizon(scores: DataFrame, key: str, bar: float) -> DataFrame:
    """Per key and feature the target with the largest absolute t (ties to the first by name) and whether it passes the bar."""
    best = scores.groupBy(key, "feature").agg(F.max_by(F.struct("target", "t"), F.struct(F.abs(F.round("t", 9)), F.col("target"))).alias("b"))
    return best.select(key, "feature", "b.target", "b.t", (F.abs("b.t") >= bar).alias("survives"))


def selected(scores: DataFrame, key: str, horizon: str, tests: int) -> DataFrame:
    """Features whose absolute t at one horizon reaches 2, and whether it passes the Bonferroni bar of so many tests."""
    one = scores.filter((F.col("target") == horizon) & (F.abs("t") >= 2))
    return one.select(key, "feature", "t", (F.abs("t") >= bonferroni_bar(tests)).alias("pooled"))


def distinct_names(*lists: list[str]) -> list[str]:
    """The names of all lists in order of their first place, each once."""
    return list(dict.fromkeys(n for names in lists for n in names))


def unused_names(names: list[str], used: list[str]) -> list[str]:
    """The names that are not used, sorted."""
    return sorted(set(names) - set(used))


def noise_floor(scores: DataFrame, ic: DataFrame, key: str, horizons: dict[str, int]) -> DataFrame:
    """Per key and target: the mean absolute ic over what chance gives for a median of n / horizon independent rows."""
    h = F.create_map(*[F.lit(x) for kv in horizons.items() for x in kv])[F.col("target")]
    per = ic.groupBy(key, "target").agg(F.avg(F.abs("ic")).alias("mean_abs_ic"), F.median("n").alias("_n"))
    floor = F.sqrt(F.lit(2 / math.pi)) / F.sqrt(F.col("_n") / h)
    return breadth(scores, key).join(per.select(key, "target", "mean_abs_ic", (F.col("mean_abs_ic") / floor).alias("noise_ratio")), [key, "target"])


def breadth(scores: DataFrame, key: str) -> DataFrame:
    """Per key and target: features with an absolute t of 2 or more, the mean absolute and the largest absolute t."""
    return scores.groupBy(key, "target").agg(F.sum((F.abs("t") >= 2).cast("long")).alias("n_strong"), F.avg(F.abs("t")).alias("mean_abs_t"), F.max(F.abs("t")).alias("max_abs_t"))


def feature_correlation(df: DataFrame, key: str, order: str, features: tuple[str, ...]) -> DataFrame:
    """key, a, b, rho: Spearman correlations of all pairs, each over the rows that have both."""
    renamed = df.withColumns({f"_{c}": F.col(c) for c in features})
    out = rank_ic(renamed, key, order, features, tuple(f"_{c}" for c in features))
    return out.select(key, F.col("feature").alias("a"), F.substring("target", 2, 100).alias("b"), F.col("ic").alias("rho"))


def greedy_prune(strength: dict[str, float], correlation: dict[tuple[str, str], float], limit: float = 0.7) -> list[str]:
    """Names by falling strength, less those correlated with a stronger one that is kept. For tens of names."""
    kept: list[str] = []
    for name in sorted(strength, key=lambda k: (-abs(strength[k]), k)):
        if all(abs(correlation.get((name, k), correlation.get((k, name), 0.0)) or 0.0) < limit for k in kept):
            kept.append(name)
    return kept
