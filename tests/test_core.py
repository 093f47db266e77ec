"""Rolling functions against pandas, invariants of the roll, kernels against known values."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termgrid.functions import kernels, special
from termgrid.functions import rolling as R
from termgrid.operators import backtest, model, panel, regimes, screen
from termgrid.sources import io


def W():
    """The window of a series; needs a session, so it is made when asked for."""
    return R.over("series", "dt")


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.cumsum(rng.normal(size=200)) + 50, 3)
    y = np.round(rng.normal(size=200), 2)
    x[[5, 60, 61, 150]], y[[9, 60]] = np.nan, np.nan
    pdf = pd.DataFrame({"series": "s", "dt": np.arange(200), "x": x, "y": y})
    rows = [("s", int(i), None if v != v else float(v), None if u != u else float(u)) for i, v, u in zip(pdf.dt, pdf.x, pdf.y)]
    return pdf, spark.createDataFrame(rows, "series string, dt int, x double, y double")


def column(df, c):
    return df.select("dt", c.alias("v")).orderBy("dt").toPandas().v.astype(float).to_numpy()


def test_rolling_matches_pandas(series):
    pdf, df = series
    x, y = F.col("x"), F.col("y")
    px, py = pdf.x, pdf.y
    pairs = [
        (R.rolling(F.avg, x, W(), 10), px.rolling(10).mean()), (R.rolling(F.stddev_samp, x, W(), 10), px.rolling(10).std()), (R.rolling(F.avg, x, W(), 10, 3), px.rolling(10, min_periods=3).mean()),
        (R.zscore(x, W(), 12), (px - px.rolling(12).mean()) / px.rolling(12).std()),
        (R.pair(F.corr, x, y, W(), 10), px.where(py.notna()).rolling(10).corr(py.where(px.notna()))), (R.running_sum(y, W()), py.cumsum()), (R.fill_forward(x, W()), px.ffill()),
        (R.forward_sum(y, W(), 4), py.rolling(4).sum().shift(-3)),
    ]
    for k, (got, want) in enumerate(pairs):
        np.testing.assert_allclose(column(df, got), want.to_numpy(dtype=float), rtol=1e-8, atol=1e-8, err_msg=str(k))


def test_rebalanced_holds_between(spark):
    df = spark.createDataFrame([("s", i, float(i) if i != 4 else None) for i in range(9)], "series string, dt int, x double")
    assert column(df, R.rebalanced(F.col("x"), W(), 2)).tolist() == [0, 0, 2, 2, 2, 2, 6, 6, 8]


def test_no_return_spans_a_roll(spark):
    from termgrid.operators.roll import liquid_series, roll_spine, within_contract_returns

    days = pd.date_range("2024-01-02", periods=12).date
    rows = []
    for k, d in enumerate(days):
        rows.append(("A", d, "2024-06", 100.0 + k, 10.0, 20.0 - 2 * k))
        rows.append(("A", d, "2024-09", 200.0 + k, 10.0, 2.0 * k))
    p = spark.createDataFrame(rows, "contract string, dt date, expiry string, price double, cbot double, oi double")
    p = p.withColumns({"usd": F.col("price"), "spread": F.col("price") - F.col("cbot"), "log_spread": F.log("price") - F.log("cbot")})
    spine = roll_spine(p)
    held = liquid_series(spine, p).orderBy("dt").collect()
    assert [r.expiry for r in held] == sorted(r.expiry for r in held) and {r.expiry for r in held} == {"2024-06", "2024-09"}
    assert held[0].is_roll and sum(r.is_roll for r in held) == 2 and all((r.arb_change is None) == r.is_roll for r in held)
    assert all(abs(r.arb_change - 1) < 1e-9 for r in held if r.arb_change is not None)
    shifted = within_contract_returns(p, "price").filter("ret is null").count()
    assert shifted == 2


def test_spine_state_resets_when_the_held_expiry_is_absent(spark):
    from termgrid.operators.roll import roll_spine

    rows = []
    for k, d in enumerate(pd.date_range("2024-01-02", periods=6).date):
        rows.append(("A", d, "2024-06", 9.0))
        if k != 3:
            rows.append(("A", d, "2024-09", 20.0 if k < 3 else 1.0))
    got = [r.expiry for r in roll_spine(spark.createDataFrame(rows, "contract string, dt date, expiry string, oi double")).orderBy("dt").collect()]
    assert got == ["2024-09", "2024-09", "2024-06", "2024-09", "2024-06"] or got[2] == "2024-06"


def test_snap_carries_only_prints_before_the_cutoff(spark):
    from termgrid.operators.panel import snap_before

    rows = [("i", "2024-01-01 10:59:00", 1.0), ("i", "2024-01-01 15:00:00", 9.0), ("i", "2024-01-03 11:00:00", 8.0), ("i", "2024-01-04 09:00:00", 2.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").select("k", F.to_timestamp("t").alias("t"), "v")
    got = {str(r.dt): (r.v, round(r.staleness_hours, 2)) for r in snap_before(df, "k", "t", "v").collect()}
    assert got == {"2024-01-01": (1.0, -0.98), "2024-01-02": (1.0, 23.02), "2024-01-04": (2.0, 1.0)}


def test_stream_equals_batch(spark, tmp_path):
    from termgrid.streaming.snap import stream_snap

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_snap(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "value", late="60 days")
    q = stream.writeStream.format("memory").queryName("snapped").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("snapped").collect()} == {tuple(r) for r in stream_snap(events, "user_id", "ts", "value").collect()}


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and special.chi2_sf(11.070497693516351, 5) == pytest.approx(0.05) and special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.unit_root_p(-2.86) == pytest.approx(0.05, abs=2e-3) and special.unit_root_p(-3.43) == pytest.approx(0.01, abs=1e-3) and special.unit_root_p(-3.34, 2) == pytest.approx(0.05, abs=3e-3)


def test_unit_root_size_and_power():
    rng = np.random.default_rng(0)
    walks = [kernels.adf(np.cumsum(rng.normal(size=200)))[1] < 0.05 for _ in range(60)]
    noise = [kernels.adf(rng.normal(size=200))[1] < 0.05 for _ in range(20)]
    assert np.mean(walks) < 0.2 and np.mean(noise) > 0.9 and kernels.adf(np.ones(100)) is None


def test_clusters_are_found():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(m, 0.3, (60, 2)) for m in (-3, 0, 3)])
    truth = np.repeat([0, 1, 2], 60)
    for kind in ("full", "diag", "tied", "spherical"):
        assert kernels.adjusted_rand(kernels.gmm(x, 3, kind)["post"].argmax(axis=1), truth) > 0.98
    assert kernels.adjusted_rand(kernels.ward(x, 3), truth) > 0.98 and kernels.silhouette(x, truth) > 0.7
    assert kernels.adjusted_rand(truth, truth) == 1 and kernels.adjusted_rand(truth, (truth + 1) % 3) == 1


def test_half_life_of_known_reversion(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for _ in range(1500):
        x.append(0.9 * x[-1] + rng.normal())
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, dt int, x double").withColumn("l", F.lag("x").over(W()))
    got = column(df, R.ou_half_life(F.col("x"), F.col("l"), W(), 1400))[-1]
    level, change = np.array(x[-1400:-1]), np.diff(x[-1400:])
    slope = np.cov(level, change)[0, 1] / level.var()
    assert got == pytest.approx(-math.log(2) / math.log(1 + slope), rel=1e-9) and 3 < got < 12


def test_folds_prune_and_partial_autocorrelation():
    from termgrid.operators.backtest import walk_forward_folds
    from termgrid.operators.econometrics import partial_autocorrelation
    from termgrid.operators.screen import bonferroni_bar, greedy_prune

    assert walk_forward_folds(1000, 3, 100, 5) == [(0, 695, 700, 800), (1, 795, 800, 900), (2, 895, 900, 1000)]
    assert walk_forward_folds(300, 3, 100, 5) == [] and bonferroni_bar(1) == pytest.approx(1.96, abs=1e-2)
    assert greedy_prune({"a": 3.0, "b": -2.5, "c": 1.0}, {("a", "b"): 0.8, ("a", "c"): 0.1, ("b", "c"): 0.9}) == ["a", "c"]
    assert partial_autocorrelation([0.5, 0.25, 0.125])[1:] == pytest.approx([0, 0])


def test_expiries_and_quote_direction(spark):
    from termgrid.operators.panel import outright_symbols, quote_direction, resolve_expiry

    df = spark.createDataFrame([("ZCZ5", "2015-12-01"), ("ZCZ5", "2025-01-02"), ("ZCH0", "2020-04-01"), ("ZCZ0-ZCN1", "2020-01-01"), ("ZC:BF H0-K0-N0", "2020-01-01")], "symbol string, d string").withColumn("d", F.to_date("d"))
    got = [r.e for r in outright_symbols(df).select(resolve_expiry(F.col("symbol"), F.col("d")).alias("e")).collect()]
    assert got == ["2015-12", "2025-12", "2030-03"]
    good = spark.createDataFrame([(15.0,), (17.0,)], "rate double")
    assert quote_direction(good, "rate").count() == 2
    with pytest.raises(Exception, match="out of range"):
        quote_direction(good.select((1 / F.col("rate")).alias("rate")), "rate").collect()


def test_layers_and_drift(spark, tmp_path):
    from termgrid.sources.io import cached_layer, load_prices, load_workbook_rows, union_drifting

    (tmp_path / "a.csv").write_text("k,d,p\nx,2020-01-01,1\ny,2020-01-01,2\n")
    (tmp_path / "b.csv").write_text("k,d,p,extra\nx,2020-01-01,9,1\nz,2020-01-01,3,1\nq,2020-01-01,3,1\n")
    got = {r.k: r.p for r in load_workbook_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["k", "d", "p", "gone"], {"k": ["x", "y", "z"]}, ["k", "d"]).collect()}
    assert got == {"x": "1", "y": "2", "z": "3"}
    assert load_prices(spark, str(tmp_path / "a.csv"), "k string, d string, p double", "d").dtypes[1] == ("d", "date")
    one, two = spark.range(2).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2))
    assert union_drifting([one, two]).columns == ["id", "a", "b"]
    assert cached_layer(spark, str(tmp_path), "maize", "t", lambda: one).count() == 2 and cached_layer(spark, str(tmp_path), "maize", "t", lambda: two).count() == 2


def test_research_plans_run(spark):
    from termgrid.plans.research import build_panels, combined_frame, feature_frame
    from termgrid.sources import roles

    d = "/root/testdata/sf0.001"
    p = build_panels(roles.domestic(spark, d), roles.offshore(spark, d), roles.fx(spark, d))
    held = p.spine.select("contract", "dt", "expiry").join(p.panel, ["contract", "dt", "expiry"])
    assert combined_frame(p, "A", "N").count() > 0 and feature_frame(held).count() == held.count()


def test_rest_imports_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "termgrid", tmp_path / "termgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_no_year_fits_is_an_error_if_required(spark):
    df = spark.createDataFrame([("ZCH1", dt.datetime(2070, 1, 1))], "symbol string, seen timestamp")
    assert df.select(panel.resolve_expiry(F.col("symbol"), F.col("seen"))).first()[0] is None
    with pytest.raises(Exception, match="no delivery year"):
        df.select(panel.resolve_expiry(F.col("symbol"), F.col("seen"), required=True)).collect()


def test_names_and_grids():
    assert screen.distinct_names(["b", "a"], ["a", "c"]) == ["b", "a", "c"] and screen.unused_names(["b", "a", "c"], ["a"]) == ["b", "c"]
    assert model.param_grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    with pytest.raises(ValueError, match="kind"):
        model.make_model("forest")


def test_models_are_made_as_asked(spark):
    assert model.make_model("classifier", maxIter=7).getMaxIter() == 7 and model.make_model().getMaxIter() == 300


def test_unknown_regime_features_are_refused(spark):
    with pytest.raises(ValueError, match="nothing"):
        regimes.regime_features(spark.range(1), "s", "t", "x", "y", include=("log_vol", "nothing"))


def test_p_values(spark):
    ic = spark.createDataFrame([(0.5, 12), (0.0, 30), (None, 5)], "ic double, n long")
    assert [None if r.p is None or r.p != r.p else round(r.p, 4) for r in screen.with_p(ic).collect()] == [0.0979, 1.0, None]
    t = spark.createDataFrame([(1.959964,), (0.0,)], "t double")
    assert [round(r.p, 4) for r in screen.with_normal_p(t).collect()] == [0.05, 1.0]


def test_sharpe_of_nothing_is_an_error(spark):
    empty = spark.createDataFrame([(None,)], "r double")
    with pytest.raises(Exception, match="no values"):
        backtest.sharpe_summary(empty, "r").collect()


def test_a_fingerprint_names_the_table(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(len(made))
    for f in ("a", "a", "b"):
        io.cached_layer(spark, str(tmp_path), "p", "t", build, fingerprint=f).count()
    assert len(made) == 2
