"""Regimes: features, diagnostics, mixture fits fanned out over tasks, stability, agreement, walk-forward labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.kernels import adjusted_rand, assign, gmm, kmeans, n_params, posteriors, silhouette, ward
from ..functions.ordered import numbered, trailing_rank
from ..functions.storage import materialize
from .mixture import SERIES, Fit, assign_all, best_fits, fit_all, in_order, silhouettes

FEATURES = ("log_vol", "vol_ratio", "trend_z", "var_ratio", "level_pctl", "leg_corr")


#: Features that are made on demand.
OPTIONAL = ("oi_trend", "drawdown_z")


def regime_features(df: DataFrame, series: str, order: str, level: str, leg: str, vol: int = 63, short: int = 21, trend: int = 63, rank: int = 756, vr_lag: int = 5, include: tuple[str, ...] = FEATURES, oi: str | None = None, year: int = 252, high: int = 126, rolling_z_vol: bool = False) -> DataFrame:
    """The named features, rows with a missing one left out. Missing changes count 0, so a gap does not void its windows.

    oi_trend: z-score over a year of the change of log open interest (column oi, 0 counts as missing) over short rows. drawdown_z:
    the cumulated change below its highest of high rows, in deviations. rolling_z_vol: log_vol as its own z-score over a year.
    """
    unknown = sorted(set(include) - {*FEATURES, *OPTIONAL})
    if unknown:
        raise ValueError(f"unknown regime features: {unknown}")
    w = R.over(series, order)
    zero = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    d = df.withColumns({"_d": zero(level), "_e": zero(leg)})
    d = d.withColumn("_c", F.sum("_d").over(R.expanding(w))).withColumn("_k", F.col("_c") - F.lag("_c", vr_lag).over(w))
    if "oi_trend" in include:
        log_oi = R.ln(F.col(oi))
        d = d.withColumn("_o", log_oi - F.lag(log_oi, short).over(w))
    sd, fast = R.rolling_std(F.col("_d"), w, vol), R.rolling_std(F.col("_d"), w, short)
    d = d.withColumn("_v", R.ln(sd * float(np.sqrt(year))))
    made = {
        "log_vol": lambda: R.zscore(F.col("_v"), w, year) if rolling_z_vol else F.col("_v"),
        "vol_ratio": lambda: R.ln(R.ratio(fast, sd)),
        "trend_z": lambda: R.rolling(F.sum, F.col("_d"), w, trend) / (sd * float(np.sqrt(trend))),
        "var_ratio": lambda: R.rolling(F.var_samp, F.col("_k"), w, vol) / (R.rolling(F.var_samp, F.col("_d"), w, vol) * vr_lag),
        "leg_corr": lambda: R.pair(F.corr, F.col("_d"), F.col("_e"), w, vol),
        "oi_trend": lambda: R.zscore(F.col("_o"), w, year),
        "drawdown_z": lambda: (F.col("_c") - R.rolling(F.max, F.col("_c"), w, high)) / (sd * float(np.sqrt(vol))),
    }
    d = d.withColumns({c: made[c]() for c in include if c in made} | {"_l": F.round(level, 9)})
    if "level_pctl" in include:
        d = trailing_rank(d.select(series, order, "_l", *[c for c in include if c in made]), series, order, "_l", "level_pctl", rank, rank // 3)
    d = d.select(series, order, *include)
    for c in include:
        d = d.filter(F.col(c).isNotNull() & (F.abs(c) < float("inf")))
    return d


def standardized(df: DataFrame, series: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns less their mean over their population deviation; 0 for a constant."""
    of = df.groupBy(series).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.nullif(F.stddev_pop(c), F.lit(0.0)).alias(f"_s_{c}"))])
    return df.join(of, series).withColumns({c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}).select(*df.columns)


def correlation_matrix(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, a, b, rho for each pair of columns, each over the rows of a key."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.groupBy(*keys).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for a, b in pairs]).alias("p")).select(*keys, F.inline("p"))


def inflation_factors(matrix: list[tuple[str, str, float]], columns: tuple[str, ...]) -> dict[str, float]:
    """Variance inflation of each column from its pairs' correlations; a table of columns, not of rows."""
    m = np.eye(len(columns))
    for a, b, rho in matrix:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = rho
    return dict(zip(columns, np.diag(np.linalg.pinv(m)).tolist(), strict=True))


def effective_size(df: DataFrame, series: str, order: str, x: str, max_lag: int = 500) -> DataFrame:
    """series, n, tau, n_eff: rows over 1 + 2 * the autocorrelations before the first that is not positive.

    The autocorrelations of a series, one task's group, come from one transform and are rounded to 9 decimals.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        e = t.sort_values(order)[x].to_numpy(dtype=float)
        e, n = e - e.mean(), len(e)
        lags = max(0, min(max_lag - 1, n - 2))
        power = np.abs(np.fft.rfft(e, 2 * n)) ** 2
        rho = np.round(np.fft.irfft(power)[1 : lags + 1] / (e @ e), 9) if e @ e > 0 else np.zeros(0)
        stop = np.flatnonzero(rho <= 0)
        tau = 1 + 2 * float(rho[: stop[0] if len(stop) else None].sum())
        return pd.DataFrame({series: [t[series].iloc[0]], "n": n, "tau": tau, "n_eff": n / tau})

    return df.filter(F.col(x).isNotNull()).select(series, order, x).groupBy(series).applyInPandas(run, f"{series} string, n long, tau double, n_eff double")


def effective_rows(df: DataFrame, series: str, order: str, columns: tuple[str, ...], max_lag: int = 500) -> DataFrame:
    """series, n, tau, n_eff: rows over the mean of the columns' autocorrelation times, as effective_size gives them."""
    long = df.select(series, order, *columns).unpivot([series, order], list(columns), "_column", "_x")
    one = effective_size(long.withColumn("_of", F.to_json(F.struct(series, "_column"))), "_of", order, "_x", max_lag)
    one = one.withColumn(series, F.get_json_object("_of", f"$.{series}"))
    return one.groupBy(series).agg(F.max("n").alias("n"), F.avg("tau").alias("tau")).withColumn("n_eff", F.col("n") / F.col("tau"))


def adjusted_rand_index(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n and the adjusted Rand index of two labelings, from their contingency counts; one row without keys."""
    ones = [*keys] or ["_one"]
    df = df if keys else df.withColumn("_one", F.lit(0))
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*ones, a, b).agg(F.count("*").alias("c"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cells.groupBy(*ones).agg(pairs("c").alias("_s"), F.sum("c").alias("n"))
    rows, cols = (cells.groupBy(*ones, k).agg(F.sum("c").alias("c")).groupBy(*ones).agg(pairs("c").alias(n)) for k, n in ((a, "_r"), (b, "_k")))
    joined = both.join(rows, ones).join(cols, ones)
    expected, top = F.col("_r") * F.col("_k") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0)), (F.col("_r") + F.col("_k")) / 2
    return joined.select(*keys, "n", F.coalesce((F.col("_s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def compare_labels(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of two labelings: keys, n, their adjusted Rand index and agreement; and the confusion as keys, a, b, n and share of a."""
    ones = [*keys] or ["_one"]
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = both if keys else both.withColumn("_one", F.lit(0))
    same = both.groupBy(*ones).agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
    ari = adjusted_rand_index(both, a, b, tuple(ones)).join(same, ones).select(*keys, "n", "ari", "agreement")
    cells = both.groupBy(*ones, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*ones, a).agg(F.sum("n").alias("_t"))
    return ari, cells.join(total, [*ones, a]).withColumn("share", F.col("n") / F.col("_t")).select(*keys, a, b, "n", "share")


def diagnostics(df: DataFrame, columns: tuple[str, ...], series: str) -> DataFrame:
    """series, column, vif, worst_with, worst_rho: variance inflation and the pair of the largest absolute correlation.

    A series' few correlations are one task's group; the rows only go into those.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        pairs = [(a, b, None if r != r else r) for a, b, r in zip(t["a"], t["b"], t["rho"].astype(float), strict=True)]
        vif = inflation_factors([(a, b, r or 0.0) for a, b, r in pairs], columns)
        rows = []
        for c in columns:
            mine = [(b if a == c else a, rho) for a, b, rho in pairs if c in (a, b) and rho is not None]
            rows.append((t[series].iloc[0], c, vif[c], *max(mine, key=lambda x: (abs(round(x[1], 9)), x[0]), default=(None, None))))
        return pd.DataFrame(rows, columns=[series, "column", "vif", "worst_with", "worst_rho"])

    return correlation_matrix(df, columns, (series,)).groupBy(series).applyInPandas(run, f"{series} string, column string, vif double, worst_with string, worst_rho double")


def confidence(df: DataFrame, posteriors: list[str], threshold: float = 0.8, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, mean and median of the largest posterior, the share above the threshold, mean entropy over its maximum."""
    top = F.greatest(*posteriors)
    entropy = sum((F.when(F.col(p) > 0, -F.col(p) * F.log(p)).otherwise(0.0) for p in posteriors), F.lit(0.0)) / float(np.log(len(posteriors)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(top).alias("mean_top"), F.median(top).alias("median_top"), F.avg((top >= threshold).cast("double")).alias("share_confident"), F.avg(entropy).alias("mean_entropy"))


def _per_task(features: DataFrame, series: str, order: str, columns: tuple[str, ...], tasks: list[dict], schema: str, run) -> DataFrame:
    """run(matrix in order of time, task, times) in a group for each series and task; series comes first in the result.

    For batteries of many small fits of one series: each group holds the series' rows, trading days by a handful of columns.
    A single fit of long series is fit_regimes', which no task holds a series for.
    """
    t = features.sparkSession.createDataFrame(pd.DataFrame(tasks).assign(task=range(len(tasks))))
    # by number, as small partitions would be put together and their groups wait for each other
    n = max(4 * len(tasks), int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = features.select(series, order, *columns).join(F.broadcast(t)).repartition(n, series, "task")
    names = list(tasks[0])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        x = g[list(columns)].to_numpy(dtype=float)
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        out = run(x, {k: g[k].iloc[0] for k in names}, g[order])
        out.insert(0, series, g[series].iloc[0])
        return out

    return rows.groupBy(series, "task").applyInPandas(one, f"{series} string, {schema}")


def _scaled(features: DataFrame, series: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """The standardized columns as a table, for the many passes of a fit."""
    return materialize(standardized(features.select(series, order, *columns), series, columns), "scaled")


def select_components(features: DataFrame, series: str, order: str, columns: tuple[str, ...], ks=(1, 2, 3, 4), kinds=("full", "diag", "tied", "spherical"), n_effective: dict[str, float] | None = None, starts: int = 10) -> DataFrame:
    """series, k, kind, loglik, params, bic, aic, bic_eff, silhouette, min_weight of a mixture for each pair, and whether it is best.

    bic_eff rescales to the effective rows of n_effective (series -> rows); without it they are all rows. Best is the least
    bic_eff of a series, the first of equal ones in the order of kinds, then ks.
    """
    z = _scaled(features, series, order, columns)
    best = best_fits(fit_all(z, series, columns, [(k, kind, i) for kind in kinds for k in ks for i in range(starts)]))
    pairs, rows, grid = [(k, kind) for kind in kinds for k in ks], [], {}
    for (s, k, kind), f in best.items():
        p, n = n_params(k, len(columns), kind), f.n
        e = (n_effective or {}).get(s, n)
        grid.setdefault(s, []).append((s, k, kind, f.loglik, p, float(p * np.log(n) - 2 * f.loglik), 2 * p - 2 * f.loglik, float(p * np.log(e) - 2 * f.loglik * e / n), float(f.weights.min()), f"l{pairs.index((k, kind))}"))
    for found in grid.values():
        least = min(range(len(found)), key=lambda i: (found[i][7], pairs.index(found[i][1:3])))
        rows += [(*r, i == least) for i, r in enumerate(found)]
    labelled = assign_all(z, series, columns, {s: [best[s, k, kind] for k, kind in pairs] for s in grid})
    scored = silhouettes(labelled, series, columns, [f"l{i}" for i in range(len(pairs))])
    table = features.sparkSession.createDataFrame(rows, f"{series} string, k int, kind string, loglik double, params int, bic double, aic double, bic_eff double, min_weight double, labelling string, best boolean")
    return table.join(scored, [series, "labelling"], "left").select(series, "k", "kind", "loglik", "params", "bic", "aic", "bic_eff", "silhouette", "min_weight", "best")


def _fits(z: DataFrame, series: str, columns: tuple[str, ...], k: int, kind: str, order_by: str | None, starts: int) -> dict[str, Fit]:
    """Each series' best fit, its components numbered by the rising centre of order_by (the first column)."""
    best = best_fits(fit_all(z, series, columns, [(k, kind, i) for i in range(starts)]))
    return {s: in_order(f, columns.index(order_by or columns[0])) for (s, _, _), f in best.items()}


def fit_regimes(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, kind: str = "full", order_by: str | None = None, starts: int = 20) -> DataFrame:
    """series, order, regime, top, p0 to p<k-1>: each row's regime, numbered by the rising centre of order_by (the first column), its
    largest posterior and all of them. Each series has a fit of its own; all are fitted together by aggregates over the rows."""
    z = _scaled(features, series, order, columns)
    fits = _fits(z, series, columns, k, kind, order_by, starts)
    out = assign_all(z, series, columns, {s: [f] for s, f in fits.items()}, posterior=True)
    return out.select(series, order, F.col("l0").alias("regime"), "top", *[f"p{j}" for j in range(k)])


def regime_centres(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, kind: str = "full", order_by: str | None = None, starts: int = 20) -> DataFrame:
    """series, regime, weight and the centre of each column in its deviations, of the fit that fit_regimes makes."""
    fits = _fits(_scaled(features, series, order, columns), series, columns, k, kind, order_by, starts)
    rows = [(s, j, float(f.weights[j]), *f.means[j].tolist()) for s, f in fits.items() for j in range(k)]
    return features.sparkSession.createDataFrame(rows, f"{series} string, regime int, weight double" + "".join(f", {c} double" for c in columns))


def stability_summary(draws: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """way, n, mean, least, median and 10th percentile of the agreement of label_stability's draws."""
    return draws.groupBy(*keys, "way").agg(F.count("*").alias("n"), F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.median("ari").alias("median_ari"), F.percentile("ari", F.lit(0.1)).alias("p10_ari"))


def reliability_battery(features: DataFrame, series: str, order: str, columns: tuple[str, ...], ks: tuple[int, ...] = (2, 3, 4, 5), kind: str = "full", seeds: int = 15, samples: int = 25, block: int = 63, share: float = 0.8, threshold: float = 0.8, starts: int = 10) -> DataFrame:
    """One row for each series and k: silhouette, share_confident, seed_ari (mean), block_ari (median), xalgo_ari (least), run lengths, switch_rate.

    Six perturbations of a k share a task and its reference fit; their results are combined by one aggregate.
    """
    draws = [("seed", i) for i in range(1, seeds + 1)] + [("block", i) for i in range(1, samples + 1)]
    tasks, names = [{"k": k, "first": i} for k in ks for i in range(0, len(draws), 6)], ["k", "way", "value", "silhouette", "share_confident", "median_run", "mean_run", "switch_rate"]

    def run(x, task, _):
        k, first, rows = int(task["k"]), int(task["first"]), []
        f = gmm(x, k, kind, starts=2 * starts)
        label, blocks = f["post"].argmax(axis=1), np.arange(-(-len(x) // block))
        for way, draw in draws[first : first + 6]:
            if way == "seed":
                ari = adjusted_rand(label, gmm(x, k, kind, draw, starts)["post"].argmax(axis=1))
            else:
                chosen = np.random.default_rng(draw).choice(blocks, max(1, int(len(blocks) * share)), replace=False)
                some = np.flatnonzero(np.isin(np.arange(len(x)) // block, chosen))
                ari = adjusted_rand(label[some], assign(gmm(x[some], k, kind, 0, starts), x[some]))
            rows.append((k, way, ari, *[None] * 5))
        if not first:
            others = [label, kmeans(x, k, np.random.default_rng(0)), ward(x, k)]
            least = min(adjusted_rand(others[i], others[j]) for i in range(3) for j in range(i))
            runs = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1, [len(label)])))
            rows.append((k, "fit", least, silhouette(x, label), float((f["post"].max(axis=1) >= threshold).mean()), float(np.median(runs)), float(runs.mean()), (len(runs) - 1) / max(len(label) - 1, 1)))
        return pd.DataFrame(rows, columns=names)

    each = _per_task(features, series, order, columns, tasks, "k int, way string, value double, silhouette double, share_confident double, median_run double, mean_run double, switch_rate double", run)
    of = lambda way: F.when(F.col("way") == way, F.col("value"))
    return each.groupBy(series, "k").agg(F.max("silhouette").alias("silhouette"), F.max("share_confident").alias("share_confident"), F.avg(of("seed")).alias("seed_ari"), F.median(of("block")).alias("block_ari"), F.min(of("fit")).alias("xalgo_ari"), F.max("median_run").alias("median_run"), F.max("mean_run").alias("mean_run"), F.max("switch_rate").alias("switch_rate"))


#: name -> settings of regime_features. The five configurations that a sweep is compared by, so that its table has the
#: same rows as the study that it repeats; other ones are given by the caller.
SWEEP = {
    "six, 63 rows": {},
    "three, 63 rows": {"include": ("log_vol", "var_ratio", "level_pctl")},
    "three, 21 rows": {"include": ("log_vol", "var_ratio", "level_pctl"), "vol": 21, "trend": 21, "short": 10, "rank": 252},
    "two, 21 rows": {"include": ("log_vol", "level_pctl"), "vol": 21, "trend": 21, "short": 10, "rank": 252},
    "prices, 42 rows": {"include": ("log_vol", "vol_ratio", "trend_z", "var_ratio"), "vol": 42, "trend": 42, "short": 15},
}


def configuration_sweep(df: DataFrame, series: str, order: str, level: str, leg: str, configurations: dict[str, dict] | None = None, ks: tuple[int, ...] = (2, 3, 4), seeds: int = 6, samples: int = 12, starts: int = 10) -> DataFrame:
    """configuration, d (columns), n_rows, n_eff, best_k (by bic_eff over all kinds, 1 included), then reliability_battery's columns.

    n_eff is effective_rows' figure, one number a series; those numbers pass through the driver. df is read once.
    """
    out = None
    needed = {series, order, level, leg, *(s["oi"] for s in (configurations or SWEEP).values() if s.get("oi"))}
    df = materialize(df.select(*[c for c in df.columns if c in needed]), "legs")
    for name, settings in (configurations or SWEEP).items():
        made, columns = regime_features(df, series, order, level, leg, **settings), settings.get("include", FEATURES)
        made = materialize(made, "features")
        size = effective_rows(made, series, order, columns)
        grid = select_components(made, series, order, columns, (1, *ks), n_effective={r[series]: r["n_eff"] for r in size.limit(SERIES).collect()}, starts=starts)
        chosen = grid.filter("best").select(series, F.col("k").alias("best_k"))
        one = reliability_battery(made, series, order, columns, ks, seeds=seeds, samples=samples, starts=starts)
        one = one.join(size.select(series, F.col("n").alias("n_rows"), "n_eff"), series).join(chosen, series).select(F.lit(name).alias("configuration"), F.lit(len(columns)).alias("d"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def label_stability(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, kind: str = "full", seeds: int = 5, samples: int = 5, block: int = 63, share: float = 0.8, starts: int = 10) -> DataFrame:
    """series, way, draw, ari: agreement of refits by seed and by sampled blocks of time with the reference fit."""

    def run(x, task, _):
        reference = gmm(x, k, kind, 0, 2 * starts)["post"].argmax(axis=1)
        if task["way"] == "seed":
            other, rows = gmm(x, k, kind, int(task["draw"]), starts)["post"].argmax(axis=1), np.arange(len(x))
        else:
            rng, blocks = np.random.default_rng(int(task["draw"])), np.arange(-(-len(x) // block))
            chosen = rng.choice(blocks, max(1, int(len(blocks) * share)), replace=False)
            rows = np.flatnonzero(np.isin(np.arange(len(x)) // block, chosen))
            other = assign(gmm(x[rows], k, kind, 0, starts), x[rows])
        return pd.DataFrame([(task["way"], int(task["draw"]), adjusted_rand(reference[rows], other))], columns=["way", "draw", "ari"])

    tasks = [{"way": "seed", "draw": i} for i in range(1, seeds + 1)] + [{"way": "block", "draw": i} for i in range(1, samples + 1)]
    return _per_task(features, series, order, columns, tasks, "way string, draw int, ari double", run)


def algorithm_agreement(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, kind: str = "full", starts: int = 10) -> DataFrame:
    """series, a, b, ari for a mixture, k-means and Ward clustering of each series.

    The first two are fitted by aggregates. Ward's criterion merges all rows of a series step by step, so it alone takes a task for each series.
    """
    z = _scaled(features, series, order, columns)
    best = best_fits(fit_all(z, series, columns, [(k, c, i) for c in (kind, "kmeans") for i in range(starts)]))
    labels = assign_all(z, series, columns, {s: [best[s, k, kind], best[s, k, "kmeans"]] for s, _, c in best if c == kind})

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        return t.append_column("l2", pa.array(ward(np.column_stack([t[c].to_numpy() for c in columns]), k), type=pa.int32()))

    labels = materialize(labels.groupBy(series).applyInArrow(add, labels.withColumn("l2", F.lit(0)).schema), "labels")
    names, out = ("mixture", "kmeans", "ward"), None
    for i, j in ((0, 1), (0, 2), (1, 2)):
        one = adjusted_rand_index(labels, f"l{i}", f"l{j}", (series,)).select(series, F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), "ari")
        out = one if out is None else out.unionByName(one)
    return out


def fold_centres(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, folds: int = 3, order_by: str | None = None, starts: int = 10) -> DataFrame:
    """series, fold, start, end, regime, weight and each column's centre, in deviations of the series, of a fit of each consecutive part."""
    at = columns.index(order_by or columns[0])

    def run(x, task, dates):
        part = np.array_split(np.arange(len(x)), folds)[int(task["fold"])]
        f = gmm(x[part], k, "full", 0, starts)
        rank = np.argsort(f["means"][:, at], kind="stable")
        found = {"fold": int(task["fold"]), "start": dates.iloc[part[0]], "end": dates.iloc[part[-1]], "regime": range(k), "weight": f["weights"][rank]}
        return pd.DataFrame(found | {c: f["means"][rank, j] for j, c in enumerate(columns)})

    kind = features.schema[order].dataType.simpleString()
    return _per_task(features, series, order, columns, [{"fold": i} for i in range(folds)], f"fold int, start {kind}, end {kind}, regime int, weight double" + "".join(f", {c} double" for c in columns), run)


def split_stability(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, folds: int = 3, order_by: str | None = None, starts: int = 10) -> DataFrame:
    """series, regime, then for each column the deviation of its centre over the folds, in deviations of the series, and max_drift."""
    drift = fold_centres(features, series, order, columns, k, folds, order_by, starts).groupBy(series, "regime").agg(*[F.stddev_samp(c).alias(c) for c in columns])
    return drift.withColumn("max_drift", F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))


def walk_forward_labels(features: DataFrame, series: str, order: str, columns: tuple[str, ...], k: int, kind: str = "full", lookback: int = 756, every: int = 63, order_by: str | None = None, starts: int = 5) -> DataFrame:
    """series, order, regime, top, refit: labels of each stretch of rows by a fit on the lookback rows before it, numbered by the rising
    centre of order_by (the first column), the largest posterior and the time of the stretch's first row. A refit is one task's
    group, of lookback + every rows; a series shorter than the lookback is refused."""
    size = features.groupBy(series).agg(F.count("*").alias("_n"))
    if size.filter(F.col("_n") <= lookback).limit(1).count():
        raise ValueError("the lookback is not shorter than the sample")
    rows = numbered(features.select(series, order, *columns), [series], order, "_r").join(size, series)
    first = F.greatest(F.lit(0), F.floor((F.col("_r") - lookback) / every)).cast("int")
    last = F.least(F.floor((F.col("_n") - 1 - lookback) / every), F.floor(F.col("_r") / every)).cast("int")
    dealt = rows.withColumn("_g", F.explode(F.when(first <= last, F.sequence(first, last)))).filter((F.col("_r") >= F.col("_g") * every) & (F.col("_r") < F.col("_g") * every + lookback + every))
    at = columns.index(order_by or columns[0])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_r")
        x = g[list(columns)].to_numpy(dtype=float)
        seen = x[:lookback]
        z = (x - seen.mean(axis=0)) / np.where(seen.std(axis=0) > 0, seen.std(axis=0), 1)
        f = gmm(z[:lookback], k, kind, 0, starts)
        rank = np.argsort(np.argsort(f["means"][:, at]))
        post = posteriors(f, z[lookback:])
        times = g[order].iloc[lookback:]
        return pd.DataFrame({series: g[series].iloc[0], order: times, "regime": rank[post.argmax(axis=1)], "top": post.max(axis=1), "refit": times.iloc[0]})

    time = features.schema[order].dataType.simpleString()
    return dealt.groupBy(series, "_g").applyInPandas(run, f"{series} string, {order} {time}, regime int, top double, refit {time}")


def walk_forward_summary(labels: DataFrame, series: str, order: str) -> DataFrame:
    """series, n_labelled, n_refits, first_labelled, last_refit of walk_forward_labels."""
    return labels.groupBy(series).agg(F.count("*").alias("n_labelled"), F.count_distinct("refit").alias("n_refits"), F.min(order).alias("first_labelled"), F.max("refit").alias("last_refit"))
