"""Fits by Spark against the numpy kernels, with several series and blocks far smaller than a series."""

from __future__ import annotations

import numpy as np
import pytest

from termgrid.functions import kernels
from termgrid.operators import mixture as M

COLUMNS = ("x", "y")


def sample(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [3, 1], [1, 4]])
    return centres[rng.integers(0, 3, n)] + rng.normal(size=(n, 2)) * [1.0, 0.6]


@pytest.fixture(scope="module")
def frame(spark):
    data = {"a": sample(1), "b": sample(2, 250)}
    rows = [(s, i, float(p[0]), float(p[1])) for s, x in data.items() for i, p in enumerate(x)]
    return data, spark.createDataFrame(rows, "s string, t int, x double, y double").repartition(4).cache()


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_fits_equal_the_kernel_from_the_same_start(frame, kind):
    data, df = frame
    start = np.array([[0.0, 1.0], [2.0, 2.0], [1.0, 3.0]])
    fits = M.best_fits(M.fit_all(df, "s", COLUMNS, [(3, kind, 0)], centres={(s, 3, 0): start for s in data}))
    assert set(fits) == {("a", 3, kind), ("b", 3, kind)}
    for s, x in data.items():
        label = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
        want, got = kernels.gmm(x, 3, kind, labels=[label]), fits[s, 3, kind]
        np.testing.assert_allclose(got.loglik, want["loglik"], rtol=1e-8)
        for a, b in ((got.weights, want["weights"]), (got.means, want["means"]), (got.covs, want["covs"])):
            np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-6)


def test_starts_find_the_groups_and_labels_follow(frame):
    data, df = frame
    fits = M.best_fits(M.fit_all(df, "s", COLUMNS, [(3, kind, i) for kind in ("full", "kmeans") for i in range(3)]))
    of = {s: [M.in_order(fits[s, 3, "full"], 0), fits[s, 3, "kmeans"]] for s in data}
    got = M.assign_all(df, "s", COLUMNS, of, posterior=True).toPandas().sort_values(["s", "t"])
    for s, x in data.items():
        mine = got[got.s == s]
        np.testing.assert_array_equal(mine.l0, of[s][0].joint(x).argmax(axis=1))
        np.testing.assert_allclose(mine[["p0", "p1", "p2"]].sum(axis=1), 1)
        assert (np.diff(of[s][0].means[:, 0]) > 0).all()
        assert kernels.adjusted_rand(mine.l0.to_numpy(), mine.l1.to_numpy()) > 0.7
        best = kernels.gmm(x, 3, "full")
        assert fits[s, 3, "full"].loglik > best["loglik"] - 1


def test_turns_of_series_give_the_same_fits(frame, monkeypatch):
    _, df = frame
    specs = [(2, "full", 0), (2, "diag", 0)]
    whole = M.fit_all(df, "s", COLUMNS, specs)
    monkeypatch.setattr(M, "AT_ONCE", 1)
    for a, b in zip(whole, M.fit_all(df, "s", COLUMNS, specs), strict=True):
        assert (a.series, a.kind) == (b.series, b.kind)
        np.testing.assert_allclose(a.loglik, b.loglik)
    monkeypatch.setattr(M, "SERIES", 1)
    with pytest.raises(ValueError, match="in parts"):
        M.fit_all(df, "s", COLUMNS, specs)


@pytest.mark.parametrize("block", [50, 10_000])
def test_silhouettes_equal_the_kernel(frame, spark, block):
    data, _ = frame
    rng, labels = np.random.default_rng(3), {}
    rows = []
    for s, x in data.items():
        one, two = (x[:, 0] > 1.5).astype(int), rng.integers(0, 4, len(x))
        two[0] = 9  # a cluster of one row
        labels[s] = (one, two, np.zeros(len(x), dtype=int))
        rows += [(s, float(p[0]), float(p[1]), int(a), int(b), 0) for p, a, b in zip(x, one, two, strict=True)]
    df = spark.createDataFrame(rows, "s string, x double, y double, u int, v int, w int")
    got = {(r.s, r.labelling): r.silhouette for r in M.silhouettes(df, "s", COLUMNS, ["u", "v", "w"], block).collect()}
    for s, x in data.items():
        for name, label in zip("uvw", labels[s], strict=True):
            want = kernels.silhouette(x, label)
            assert got[s, name] is None if want is None else abs(got[s, name] - want) < 1e-9


def test_fits_within_tasks_are_those_of_rounds(frame, monkeypatch):
    """Series up to WHOLE_ROWS take one job; one longer, one shorter and both longer give the same fits."""
    _, df = frame
    specs = [(k, kind, i) for k in (1, 3) for kind in ("full", "tied", "kmeans") for i in range(2)]
    steps, step = [], M._step
    monkeypatch.setattr(M, "_step", lambda z, series, columns, fits: steps.append(sorted({f.series for f in fits})) or step(z, series, columns, fits))
    got = M.fit_all(df, "s", COLUMNS, specs)
    assert not steps and not any(f.live for f in got)
    for rows, long in ((300, ["a"]), (0, ["a", "b"])):
        monkeypatch.setattr(M, "WHOLE_ROWS", rows)
        other = M.fit_all(df, "s", COLUMNS, specs)
        assert steps and steps[0] == long
        steps.clear()
        for f, g in zip(got, other, strict=True):
            assert (f.series, f.k, f.kind, f.start, f.n) == (g.series, g.k, g.kind, g.start, g.n)
            np.testing.assert_allclose(f.loglik, g.loglik, rtol=1e-9)
            np.testing.assert_allclose(f.centres, g.centres, rtol=1e-6, atol=1e-8)
            assert (f.covs is None) == (g.covs is None) == (f.kind == "kmeans")
            if f.covs is not None:
                np.testing.assert_allclose(f.weights, g.weights, rtol=1e-6)
                np.testing.assert_allclose(f.covs, g.covs, rtol=1e-6, atol=1e-8)
