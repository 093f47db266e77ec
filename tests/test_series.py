"""Fits, labels and models of several series at once equal those of each series alone."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from termgrid.operators import econometrics, model, regimes

COLUMNS = ("u", "v")


@pytest.fixture(scope="module")
def frame(spark):
    """Two series of different lengths; the second one's columns have other scales."""
    rows = []
    for s, n, scale in (("a", 420, 1.0), ("b", 300, 40.0)):
        rng = np.random.default_rng(len(s) + n)
        state = (np.arange(n) // 30) % 2
        x = rng.normal(size=(n, 2)) + state[:, None] * [3.0, -2.0]
        rows += [(s, dt.date(2010, 1, 1) + dt.timedelta(days=i), float(p[0]) * scale, float(p[1]) * scale, float(rng.normal())) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "s string, dt date, u double, v double, y double").repartition(3).cache()


def alone(df, name):
    return df.filter(F.col("s") == name)


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_each_series_has_a_fit_of_its_own(frame):
    both = regimes.fit_regimes(frame, "s", "dt", COLUMNS, 2, starts=3)
    assert both.count() == frame.count() and both.columns == ["s", "dt", "regime", "top", "p0", "p1"]
    for name in "ab":
        assert rows(alone(both, name)) == rows(regimes.fit_regimes(alone(frame, name), "s", "dt", COLUMNS, 2, starts=3))
    centres = {(r.s, r.regime): r for r in regimes.regime_centres(frame, "s", "dt", COLUMNS, 2, starts=3).collect()}
    assert len(centres) == 4 and all(centres[s, 0].u < centres[s, 1].u for s in "ab")


def test_the_grid_names_the_best_row_of_each_series(frame):
    grid = regimes.select_components(frame, "s", "dt", COLUMNS, (1, 2, 3), ("full", "spherical"), starts=2).collect()
    assert len(grid) == 12
    for name in "ab":
        mine = [r for r in grid if r.s == name]
        best = [r for r in mine if r.best]
        assert len(best) == 1 and best[0].bic_eff == min(r.bic_eff for r in mine) and best[0].k == 2
        assert all((r.silhouette is None) == (r.k == 1) for r in mine)


def test_walked_labels_know_their_refit(frame):
    got = regimes.walk_forward_labels(frame, "s", "dt", COLUMNS, 2, lookback=200, every=60)
    for name, n in (("a", 420), ("b", 300)):
        mine = alone(got, name)
        assert mine.count() == n - 200 and rows(mine) == rows(regimes.walk_forward_labels(alone(frame, name), "s", "dt", COLUMNS, 2, lookback=200, every=60))
        assert mine.filter("refit > dt or top < 0.5 or top > 1").count() == 0
    summary = {r.s: (r.n_labelled, r.n_refits, r.first_labelled) for r in regimes.walk_forward_summary(got, "s", "dt").collect()}
    first = dt.date(2010, 1, 1) + dt.timedelta(days=200)
    assert summary == {"a": (220, 4, first), "b": (100, 2, first)}
    with pytest.raises(ValueError, match="lookback"):
        regimes.walk_forward_labels(frame, "s", "dt", COLUMNS, 2, lookback=300)


def test_batteries_are_by_series(frame):
    stable = regimes.label_stability(frame, "s", "dt", COLUMNS, 2, seeds=2, samples=1, starts=2)
    assert {(r.s, r.way) for r in stable.collect()} == {(s, w) for s in "ab" for w in ("seed", "block")} and stable.filter("ari < 0.9").count() == 0
    folds = regimes.fold_centres(frame, "s", "dt", COLUMNS, 2, starts=2)
    assert folds.count() == 12 and folds.filter("start > end").count() == 0
    assert regimes.split_stability(frame, "s", "dt", COLUMNS, 2, starts=2).filter("max_drift > 0.5").count() == 0
    agree = regimes.algorithm_agreement(frame, "s", "dt", COLUMNS, 2, starts=2)
    assert agree.count() == 6 and agree.filter("ari < 0.8").count() == 0
    size = {r.s: (r.n, r.n_eff) for r in regimes.effective_rows(frame, "s", "dt", COLUMNS).collect()}
    assert size["a"][0] == 420 and size["b"][0] == 300 and all(e < n for n, e in size.values())


def test_labels_are_compared_by_series(frame):
    df = frame.withColumns({"p": (F.col("u") > 0).cast("int"), "q": F.when(F.col("s") == "a", (F.col("u") > 0).cast("int")).otherwise(0)})
    both, cells = regimes.compare_labels(df, "p", "q", ("s",))
    got = {r.s: r for r in both.collect()}
    assert got["a"].ari == 1 and got["a"].agreement == 1 and abs(got["b"].ari) < 1e-9 and got["b"].agreement < 1
    assert abs(sum(r.share for r in cells.collect()) - 4) < 1e-9
    assert regimes.compare_labels(df, "p", "q")[0].first().n == 720


def test_walk_forward_models_are_by_series(frame):
    out, folds, summary = model.run_walk_forward(frame, "s", "dt", COLUMNS, "y", 2, min_train=100, maxIter=2)
    assert {(r.s, r.fold) for r in folds.collect()} == {(s, f) for s in "ab" for f in (0, 1)} and {r.s for r in summary.collect()} == {"a", "b"}
    sizes = {r.s: r["count"] for r in out.groupBy("s").count().collect()}
    assert sizes == {"a": 84, "b": 60}
    _, only, _ = model.run_walk_forward(frame, "s", "dt", COLUMNS, "y", 1, min_train=300, maxIter=2)
    assert {r.s for r in only.collect()} == {"a"}
    with pytest.raises(ValueError, match="no fold"):
        model.run_walk_forward(frame, "s", "dt", COLUMNS, "y", 1, min_train=1000)


def test_regression_of_blocks_is_that_of_the_series(frame, monkeypatch):
    from termgrid.functions import ordered

    whole = rows(econometrics.hac_regression(frame, "s", "dt", "y", COLUMNS, 4))
    monkeypatch.setattr(ordered.in_blocks, "__defaults__", (0, 40, "month", 50))
    assert rows(econometrics.hac_regression(frame, "s", "dt", "y", COLUMNS, 4)) == whole
    for name in "ab":
        t = alone(frame, name).toPandas().sort_values("dt")
        x = np.column_stack([np.ones(len(t)), t.u, t.v])
        beta = np.linalg.lstsq(x, t.y, rcond=None)[0]
        u = x * (t.y.to_numpy() - x @ beta)[:, None]
        meat = u.T @ u + sum((1 - k / 5) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 5))
        inv = np.linalg.inv(x.T @ x)
        t_want = beta / np.sqrt(np.diag(inv @ meat @ inv))
        got = {r[1]: (r[2], r[3]) for r in whole if r[0] == name}
        np.testing.assert_allclose([got[c] for c in ("const", *COLUMNS)], np.column_stack([beta, t_want]), atol=2e-6)


def test_autoregression_of_levels_far_from_zero(spark):
    """Levels about 20,000 with deviations of 1: equal to the solution in whole fractions, where products of the levels keep too few digits."""
    from fractions import Fraction

    v = (np.random.default_rng(3).normal(size=300) + 20_000).tolist()
    series = [("far", i, x) for i, x in enumerate(v)] + [("still", i, 7.3) for i in range(30)]
    got = {(r.name, r.term): (r.coef, r.se) for r in econometrics.autoregression(spark.createDataFrame(series, "name string, t int, x double"), "name", "t", "x", 2).collect()}

    def solved(a, b):
        m = [[*r, y] for r, y in zip(a, b, strict=True)]
        for i in range(len(m)):
            m = [r if j == i else [x - r[i] / m[i][i] * y for x, y in zip(r, m[i], strict=True)] for j, r in enumerate(m)]
        return [m[i][-1] / m[i][i] for i in range(len(m))]

    f = [Fraction(x) for x in v]
    x, y = [[Fraction(1), f[i - 1], f[i - 2]] for i in range(2, len(f))], f[2:]
    a, b = [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)], [sum(r[i] * w for r, w in zip(x, y, strict=True)) for i in range(3)]
    beta = solved(a, b)
    s2 = sum((w - sum(p * q for p, q in zip(beta, r, strict=True))) ** 2 for r, w in zip(x, y, strict=True)) / (len(y) - 3)
    for i, term in enumerate(("const", "lag1", "lag2")):
        se = float(solved(a, [Fraction(int(i == j)) for j in range(3)])[i] * s2) ** 0.5
        assert got["far", term] == pytest.approx((float(beta[i]), se), rel=1e-9)
    assert got["still", "const"] == pytest.approx((7.3, 0), abs=1e-12) and got["still", "lag1"] == (0, 0)


def test_a_sweep_reads_its_input_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for t in batches:
            seen.add(len(t))
            yield t

    df = frame.select("s", "dt", "u", "v").mapInPandas(count, "s string, dt date, u double, v double")
    two = {name: {"include": ("log_vol", "trend_z"), "vol": n, "trend": n, "short": 5} for name, n in (("wide", 20), ("narrow", 10))}
    got = regimes.configuration_sweep(df, "s", "dt", "u", "v", two, ks=(2,), seeds=1, samples=1, starts=1).collect()
    assert {(r.configuration, r.s, r.k) for r in got} == {(c, s, 2) for c in two for s in "ab"} and seen.value == frame.count()
