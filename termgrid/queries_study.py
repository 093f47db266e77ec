"""More registered queries: contract statistics, hedges, responses, econometrics, regimes and walk-forward models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import rolling as R
from .functions.storage import materialize
from .operators import backtest, econometrics, features, model, panel, profile, regimes, screen
from .queries import _LABEL, _NW, _PNL, FRAME, W, _labelled, _screened, _traded, query, roll_sql, rounded, spread_panel_of, z_sql
from .sources import roles

_BY = "PARTITION BY contract, expiry ORDER BY dt"


def _expiry_sql(text: str) -> str:
    """SQL of windows by series as windows by contract and expiry."""
    return text.replace("PARTITION BY series ORDER BY dt", _BY)


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


# ---------------------------------------------------------------- panel


@query("""+
o AS (SELECT *, max(ts) OVER (PARTITION BY instrument, symbol) AS last_seen FROM bars WHERE regexp_matches(symbol, '^ZC([HKNUZ])(\\d)$')),
m AS (SELECT *, CASE substr(symbol, 3, 1) WHEN 'H' THEN 3 WHEN 'K' THEN 5 WHEN 'N' THEN 7 WHEN 'U' THEN 9 ELSE 12 END AS month, CAST(substr(symbol, 4, 1) AS INTEGER) AS digit FROM o),
k AS (SELECT DISTINCT instrument, symbol, last_seen, month, digit FROM m),
x AS (SELECT instrument, symbol, (SELECT CAST(min(y.y) AS VARCHAR) FROM range(2000, 2061) y(y) WHERE y.y % 10 = digit AND y.y * 12 + month >= year(last_seen) * 12 + month(last_seen)) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS expiry FROM k),
prints AS (SELECT instrument, symbol, CAST(ts AS DATE) AS dt, max((ts, close)) AS p FROM m WHERE hour(ts) < 11 GROUP BY 1, 2, 3),
cal AS (SELECT instrument, symbol, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM prints GROUP BY 1, 2),
filled AS (SELECT c.*, last_value(p.p[1] IGNORE NULLS) OVER w AS ts, last_value(p.p[2] IGNORE NULLS) OVER w AS close FROM cal c LEFT JOIN prints p ON c.instrument = p.instrument AND c.symbol = p.symbol AND c.dt = p.dt WINDOW w AS (PARTITION BY c.instrument, c.symbol ORDER BY c.dt ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, (epoch_us(CAST(dt AS TIMESTAMP)) / 3.6e9 + 10) - epoch_us(ts) / 3.6e9 AS h FROM filled)
SELECT s.instrument, s.symbol, expiry, dt, round(close * (39.3683 / 100), 5) AS usd_per_tonne, round(h, 4) AS staleness_hours FROM s JOIN x ON s.instrument = x.instrument AND s.symbol = x.symbol WHERE h <= 30""")
def hourly_bars_to_snap(spark, d):
    return rounded(panel.hourly_bars_to_snap(roles.bars(spark, d)), usd_per_tonne=5, staleness_hours=4)


@query("SELECT contract, dt, expiry, oi FROM panel WHERE CAST(left(expiry, 4) AS INTEGER) >= 1994 AND CAST(right(expiry, 2) AS INTEGER) IN (4, 7, 10) AND oi >= 30")
def select_contracts(spark, d):
    return panel.select_contracts(spread_panel_of(spark, d), 1994, (4, 7, 10), 30).select("contract", "dt", "expiry", "oi")


_LEGS = "l AS (SELECT a.dt, CASE WHEN a.level > 360 THEN a.level ELSE 0 END AS x, CASE WHEN b.level > 1500 THEN b.level END AS y FROM daily a LEFT JOIN daily b ON a.dt = b.dt AND b.series = 'orders' WHERE a.series = 'lineitem')"


def _legs(spark, d):
    day = roles.daily(spark, d)
    b = day.filter("series = 'orders'").select("dt", F.when(F.col("level") > 1500, F.col("level")).alias("y"))
    return day.filter("series = 'lineitem'").select("dt", F.when(F.col("level") > 360, F.col("level")).otherwise(0.0).alias("x")).join(b, "dt", "left")


@query("+ " + _LEGS + " SELECT count(*) AS n, count(*) FILTER (x <= 0 OR y IS NULL) AS n_dropped, count(*) FILTER (x <= 0) AS n_x, count(*) FILTER (y IS NULL) AS n_y FROM l")
def legs_dropped(spark, d):
    return panel.legs_dropped(_legs(spark, d), "x", "y")


@query("+ " + _LEGS + " SELECT dt, nullif(x, 0) AS x, y FROM l")
def zero_to_null(spark, d):
    return panel.zero_to_null(_legs(spark, d), "x", "y")


@query("SELECT series, dt, level FROM daily WHERE dt >= DATE '1994-01-01' AND dt < DATE '1995-07-01'")
def date_slice(spark, d):
    return panel.date_slice(roles.daily(spark, d), "dt", "1994", "1995-06").select("series", "dt", "level")


@query(" UNION ALL ".join(f"SELECT series, DATE '{x}' AS date, count(*) FILTER (dt < DATE '{x}') AS position FROM daily GROUP BY 1" for x in ("1993-03-01", "1996-12-31")))
def rows_before(spark, d):
    return panel.rows_before(roles.daily(spark, d), "series", "dt", ["1993-03-01", "1996-12-31"])


# ---------------------------------------------------------------- contracts


@query("SELECT contract, expiry, count(spread) AS n, round(stddev_samp(spread), 5) AS spread_std, round(max(spread) - min(spread), 5) AS spread_range FROM panel GROUP BY 1, 2")
def contract_spread_range(spark, d):
    return rounded(profile.spread_by_key(spread_panel_of(spark, d), ["contract", "expiry"], "spread"), spread_std=5, spread_range=5)


@query("SELECT contract, round(median(price), 5) AS price_median, round(median(usd), 5) AS usd_median, round(median(spread), 5) AS spread_median FROM panel GROUP BY 1")
def contract_medians(spark, d):
    return rounded(profile.group_medians(spread_panel_of(spark, d), ["contract"], ("price", "usd", "spread")), price_median=5, usd_median=5, spread_median=5)


_FITS = "f AS (SELECT contract, expiry, regr_slope(log_usd, log_cbot) AS beta, regr_r2(log_usd, log_cbot) AS r2, count(*) AS n FROM panel GROUP BY 1, 2 HAVING count(*) >= 10), s AS (SELECT contract, expiry, stddev_samp(spread) AS spread_std, max(spread) - min(spread) AS spread_range FROM panel GROUP BY 1, 2), c AS (SELECT f.contract, f.expiry, beta, r2, n, spread_std, spread_range FROM f JOIN s ON f.contract = s.contract AND f.expiry = s.expiry)"


def _contract_statistics(spark, d):
    p = spread_panel_of(spark, d)
    fits = econometrics.engle_granger(p.withColumn("key", F.struct("contract", "expiry")), "key", "log_usd", "log_cbot", 10).select("key.*", "beta", "r2", "n")
    return fits.join(profile.spread_by_key(p, ["contract", "expiry"], "spread").drop("n"), ["contract", "expiry"])


@query("+ " + _FITS + " SELECT contract, expiry, round(beta, 5) AS beta, round(r2, 6) AS r2, n, round(spread_std, 5) AS spread_std, round(spread_range, 5) AS spread_range FROM c")
def contract_statistics(spark, d):
    return rounded(_contract_statistics(spark, d), beta=5, spread_std=5, spread_range=5)


@query("+ " + _FITS + " SELECT contract, round(corr(beta, r2), 6) AS beta_r2, round(corr(beta, spread_std), 6) AS beta_std, round(corr(r2, spread_range), 6) AS r2_range, count(*) AS n FROM c GROUP BY 1")
def cross_section_correlations(spark, d):
    c = _contract_statistics(spark, d).groupBy("contract")
    return rounded(c.agg(F.corr("beta", "r2").alias("beta_r2"), F.corr("beta", "spread_std").alias("beta_std"), F.corr("r2", "spread_range").alias("r2_range"), F.count("*").alias("n")))


@query("+ g AS (SELECT *, regr_slope(log_usd, log_cbot) OVER k AS b, regr_intercept(log_usd, log_cbot) OVER k AS a, count(*) OVER k AS n FROM panel WINDOW k AS (PARTITION BY contract, expiry)) SELECT contract, expiry, dt, round(log_usd - a - b * log_cbot, 6) AS residual FROM g WHERE n >= 10")
def engle_granger_residuals(spark, d):
    p = spread_panel_of(spark, d).withColumn("key", F.concat_ws(" ", "contract", "expiry"))
    out = econometrics.residuals(p, econometrics.engle_granger(p, "key", "log_usd", "log_cbot", 10), "key", "log_usd", "log_cbot")
    return rounded(out.select("contract", "expiry", "dt", "residual"))


@query(_expiry_sql("SELECT contract, expiry, dt, round(" + z_sql("spread", 20) + ", 5) AS spread_z, round(" + roll_sql("stddev_samp", "ch", 15) + ", 5) AS spread_vol, round(volume / nullif(" + roll_sql("avg", "volume", 10) + ", 0), 6) AS volume_ratio, round(" + roll_sql("avg", "volume", 5) + " / nullif(" + roll_sql("avg", "volume", 10) + ", 0), 6) AS volume_trend FROM (SELECT *, spread - lag(spread) OVER (PARTITION BY series ORDER BY dt) AS ch FROM panel)"))
def within_expiry_features(spark, d):
    df = features.within_expiry(spread_panel_of(spark, d), "spread", "volume", 20, 15, 10, 5, 10)
    return rounded(df.select("contract", "expiry", "dt", "spread_z", "spread_vol", "volume_ratio", "volume_trend"), spread_z=5, spread_vol=5)


# ---------------------------------------------------------------- hedges


def _pair_sql(agg: str, x: str, y: str, n: int) -> str:
    f = FRAME.format(n - 1)
    return f"CASE WHEN count({x} + {y}) {f} >= {n} THEN {agg} {f} END"


def _slope(x: str, y: str, n: int) -> str:
    both = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"({_pair_sql(f'covar_samp({x}, {y})', x, y, n)} / nullif({_pair_sql(f'var_samp({both})', x, y, n)}, 0))"


@query("+ h AS (SELECT series, dt, row_number() OVER (PARTITION BY series ORDER BY dt) AS r, " + _slope("x", "y", 120) + " AS h FROM both_legs) SELECT series, dt, round(last_value(CASE WHEN (r - 1) % 5 = 0 THEN h END IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) AS hedge_ratio FROM h")
def frozen_hedge_ratio(spark, d):
    return rounded(features.frozen_hedge_ratio(roles.both_legs(spark, d), "x", "y", W()).select("series", "dt", "hedge_ratio"))


@query("+ c AS (SELECT series, dt, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy FROM both_legs WINDOW o AS (PARTITION BY series ORDER BY dt)), b AS (SELECT series, dt, " + _slope("dx", "dy", 60) + " AS f, " + _slope("dx", "dy", 120) + " AS s FROM c) SELECT series, dt, round(" + roll_sql("stddev_samp", "s", 60) + ", 6) AS beta_std, round(f - s, 6) AS beta_gap FROM b")
def beta_stability(spark, d):
    return rounded(features.beta_stability(roles.both_legs(spark, d), "x", "y", W()).select("series", "dt", "beta_std", "beta_gap"))


_ARB = "g AS (SELECT series, dt, x - y AS lv, CASE WHEN volume % 7 <> 0 THEN ln(x) - lag(ln(x)) OVER o END AS rx, ln(y) - lag(ln(y)) OVER o AS ry FROM both_legs WINDOW o AS (PARTITION BY series ORDER BY dt)), a AS (SELECT series, dt, lv AS arb_level, coalesce(CASE WHEN rx IS NOT NULL THEN lv - lag(lv) OVER (PARTITION BY series ORDER BY dt) END, 0) AS arb_change, coalesce(rx, 0) AS rx, coalesce(CASE WHEN rx IS NOT NULL THEN ry END, 0) AS ry, rx IS NULL AS is_gap FROM g)"


def _arb(spark, d):
    w = W()
    df = roles.both_legs(spark, d)
    change = lambda c: R.ln(F.col(c)) - F.lag(R.ln(F.col(c))).over(w)
    df = df.withColumns({"lv": F.col("x") - F.col("y"), "rx": F.when(F.col("volume") % 7 != 0, change("x")), "ry": change("y")})
    return features.prepare_arb(df.withColumn("gap", F.col("rx")), w, "lv", "gap", ("rx", "ry"))


@query("+ " + _ARB + " SELECT series, dt, round(arb_level, 6) AS arb_level, round(arb_change, 6) AS arb_change, round(rx, 6) AS rx, round(ry, 6) AS ry, is_gap FROM a")
def prepare_arb(spark, d):
    return rounded(_arb(spark, d).select("series", "dt", "arb_level", "arb_change", "rx", "ry", "is_gap"))


@query("+ " + _ARB + " SELECT series, CAST(month(dt) AS INTEGER) AS month, count(*) AS n, round(avg(rx) * 25200, 4) AS rx_ann_pct, round(avg(ry) * 25200, 4) AS ry_ann_pct, round(corr(arb_change, rx), 6) AS corr_change_rx, round(corr(arb_change, ry), 6) AS corr_change_ry, round(corr(rx, ry), 6) AS corr_legs FROM a GROUP BY 1, 2")
def arb_response_legs(spark, d):
    return rounded(profile.leg_response(_arb(spark, d).withColumn("month", F.month("dt")), ["series", "month"], "arb_change", "rx", "ry"), rx_ann_pct=4, ry_ann_pct=4)


# ---------------------------------------------------------------- profiles


_STATE = "l AS (SELECT series, dt, level, volume, " + _LABEL + " AS state, coalesce(ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt), 0) AS ret FROM daily)"


def _states(spark, d):
    return _labelled(spark, d).withColumn("ret", F.coalesce(R.ln(F.col("level")) - F.lag(R.ln(F.col("level"))).over(W()), F.lit(0.0)))


def _ahead(h: int) -> str:
    w = f"OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return f"CASE WHEN count(ret) {w} >= {h} THEN sum(ret) {w} END AS f{h}"


@query("+ " + _STATE + ", f AS (SELECT *, " + ", ".join(_ahead(h) for h in (1, 5, 10, 20)) + " FROM l) SELECT series, state, count(*) AS n, " + ", ".join(f"round(avg(f{h}), 6) AS fwd_{h}_mean, round(avg(f{h}) / nullif(stddev_samp(f{h}), 0) * sqrt(count(f{h})), 4) AS fwd_{h}_t" for h in (1, 5, 10, 20)) + ", round(avg(level), 5) AS mean_level, round(avg(volume), 5) AS mean_volume FROM f GROUP BY 1, 2")
def forward_by_state(spark, d):
    out = profile.forward_by_label(_states(spark, d), "series", "dt", "state", "ret", features=("level", "volume"))
    return rounded(out, mean_level=5, mean_volume=5, **{f"fwd_{h}_t": 4 for h in (1, 5, 10, 20)})


@query("+ " + _STATE + ", u AS (SELECT series, state, 'month' AS unit, CAST(month(dt) AS INTEGER) AS value FROM l UNION ALL SELECT series, state, 'year', CAST(year(dt) AS INTEGER) FROM l), n AS (SELECT series, unit, value, state, count(*) AS n FROM u GROUP BY 1, 2, 3, 4) SELECT *, round(n / sum(n) OVER (PARTITION BY series, unit, value), 6) AS share FROM n")
def state_occupancy(spark, d):
    return rounded(profile.occupancy(_states(spark, d), "series", "dt", "state"))


@query("+ " + _STATE + ", p AS (SELECT *, CASE WHEN level > avg(level) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) THEN 'high' ELSE 'low' END AS slow FROM l), c AS (SELECT state, slow, count(*) AS c FROM p GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n, sum(CASE WHEN state = slow THEN c ELSE 0 END) / sum(c) AS agreement FROM c), r AS (SELECT sum(c * (c - 1) / 2) AS r FROM (SELECT sum(c) AS c FROM c GROUP BY state)), k AS (SELECT sum(c * (c - 1) / 2) AS k FROM (SELECT sum(c) AS c FROM c GROUP BY slow)) SELECT CAST(n AS BIGINT) AS n, round((s - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari, round(agreement, 6) AS agreement FROM s, r, k")
def compare_labels(spark, d):
    both = _states(spark, d).withColumn("slow", F.when(F.col("level") > F.avg("level").over(R.last_rows(W(), 60)), "high").otherwise("low"))
    return rounded(regimes.compare_labels(both, "state", "slow")[0])


@query(" UNION ALL ".join(f"SELECT series, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 5) AS q{q}" for q in (25, 50, 75)) + f", round(max({c}), 5) AS max FROM daily GROUP BY 1" for c in ("level", "volume")))
def describe(spark, d):
    return rounded(profile.describe(roles.daily(spark, d), "series", ("level", "volume")), **{c: 5 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


@query("SELECT count(*) AS n, count(DISTINCT contract || ' ' || expiry) AS n_keys, min(dt) AS first_dt, max(dt) AS last_dt, round(median(spread), 5) AS median, count(*) FILTER (spread < 0) AS n_flagged FROM panel")
def build_report(spark, d):
    p = spread_panel_of(spark, d).withColumn("key", F.concat_ws(" ", "contract", "expiry"))
    return rounded(profile.build_report(p, "key", "dt", "spread", F.col("spread") < 0), median=5)


@query("+ r AS (" + " UNION ALL ".join(f"SELECT series, {h} AS period, lead(level, {h}) OVER (PARTITION BY series ORDER BY dt) / level - 1 AS r FROM daily" for h in (1, 5, 20)) + ") SELECT period, round(avg(r) FILTER (series = 'lineitem'), 6) AS lineitem, round(avg(r) FILTER (series = 'orders'), 6) AS orders FROM r GROUP BY 1")
def holding_periods(spark, d):
    return rounded(profile.holding_periods(roles.daily(spark, d), "series", "dt", "level", (1, 5, 20), ["lineitem", "orders"]))


@query("SELECT series, dt, coalesce(CASE WHEN x >= y THEN x END, 0) AS v, NOT x >= y AS is_gap FROM both_legs")
def prepare_returns(spark, d):
    return profile.prepare_returns(roles.both_legs(spark, d).withColumn("v", F.when(F.col("x") >= F.col("y"), F.col("x"))), "series", "dt", "v")


@query("SELECT series, dt FROM both_legs WHERE NOT x >= y")
def gap_dates(spark, d):
    return profile.gap_dates(roles.both_legs(spark, d).withColumn("v", F.when(F.col("x") >= F.col("y"), F.col("x"))), "series", "dt", "v")


_NAMES = ("click", "error", "purchase")


@query("+ w AS (SELECT CAST(ts AS DATE) AS dt, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}_high, min(value) FILTER (event_type = '{t}') AS {t}_low" for t in _NAMES) + " FROM events GROUP BY 1) SELECT * FROM w WHERE " + " AND ".join(f"{t}_high IS NOT NULL" for t in _NAMES))
def flattened(spark, d):
    long = _events(spark, d).groupBy(F.to_date("ts").alias("dt"), "event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"))
    return profile.flattened(long, "dt", "event_type", list(_NAMES), ("high", "low"))


# ---------------------------------------------------------------- screen


@query(_NW + f" SELECT series, feature, round(t, 5) AS t, abs(t) >= {screen.bonferroni_bar(4)!r} AS pooled FROM nw WHERE target = 't5' AND abs(t) >= 2")
def pooled_selection(spark, d):
    scores = screen.nw_t(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"), 5)
    return rounded(screen.selected(scores, "series", "t5", 4), t=5)


@query(_NW + ", ic AS (SELECT series, target, avg(abs(ic)) AS m, median(n) AS n FROM (SELECT series, feature, target, corr(rx, ry) AS ic, count(*) AS n FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2), bb AS (SELECT series, target, count(*) FILTER (abs(t) >= 2) AS n_strong, avg(abs(t)) AS mean_abs_t, max(abs(t)) AS max_abs_t FROM nw GROUP BY 1, 2) SELECT bb.series, bb.target, n_strong, round(mean_abs_t, 5) AS mean_abs_t, round(max_abs_t, 5) AS max_abs_t, round(m, 6) AS mean_abs_ic, round(m / (sqrt(2 / pi()) / sqrt(n / CASE bb.target WHEN 't1' THEN 1 ELSE 5 END)), 5) AS noise_ratio FROM bb JOIN ic ON bb.series = ic.series AND bb.target = ic.target")
def screen_noise_floor(spark, d):
    df = _screened(spark, d)
    args = ("series", "dt", ("lz", "vz"), ("t1", "t5"))
    return rounded(screen.noise_floor(screen.nw_t(df, *args, 5), screen.rank_ic(df, *args), "series", {"t1": 1, "t5": 5}), mean_abs_t=5, max_abs_t=5, noise_ratio=5)


@query()
def rank_ic_p(spark, d):
    return rounded(screen.with_p(screen.rank_ic(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"))))


@query()
def nw_t_p(spark, d):
    return rounded(screen.with_normal_p(screen.nw_t(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"), 5)), t=5)


# ---------------------------------------------------------------- performance


@query(_PNL + " SELECT round(avg(pnl - 0.02 / 252) / stddev_samp(pnl) * sqrt(252), 5) AS sharpe, round(avg(pnl - 0.02 / 252), 6) AS mean_period, round(stddev_samp(pnl), 6) AS std_period, round(avg(pnl - 0.02 / 252) * 252, 5) AS ann_return, round(stddev_samp(pnl) * sqrt(252), 5) AS ann_vol, count(pnl) AS n FROM p")
def sharpe_summary(spark, d):
    t = _traded(spark, d).filter("sig is not null and fwd is not null").withColumn("pnl", F.signum("sig") * F.col("fwd"))
    return rounded(backtest.sharpe_summary(t, "pnl", risk_free=0.02), sharpe=5, ann_return=5, ann_vol=5)


# ---------------------------------------------------------------- econometrics


def _lags(x: str, n: int) -> str:
    return f"e{x} AS (SELECT series, dt, {x} - avg({x}) OVER (PARTITION BY series) AS e FROM v), l{x} AS (SELECT series, e, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY series ORDER BY dt) AS e{k}" for k in range(1, n + 1)) + f" FROM e{x}), s{x} AS (SELECT series, count(*) AS n, sum(e * e) AS v, " + ", ".join(f"sum(e * e{k}) AS c{k}" for k in range(1, n + 1)) + f" FROM l{x} GROUP BY 1)"


def _q(x: str, m: int) -> str:
    return "(" + " + ".join(f"power(c{k} / v, 2) / (n - {k})" for k in range(1, m + 1)) + ") * n * (n + 2)"


def _tail(q: str, m: int) -> str:
    """Upper tail of chi-squared with an even number of degrees: a finite sum."""
    return f"exp(-{q} / 2) * (1 + " + " + ".join(f"power({q} / 2, {k}) / {math.factorial(k)}" for k in range(1, m // 2)) + ")"


_WHITE = "+ v AS (SELECT series, dt, ret AS a, ret * ret AS b FROM (SELECT series, dt, ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt) AS ret FROM daily) WHERE ret IS NOT NULL), " + _lags("a", 60) + ", " + _lags("b", 20) + ", qa AS (" + " UNION ALL ".join(f"SELECT series, n, {m} AS lags, {_q('a', m)} AS q, {_tail(_q('a', m), m)} AS p FROM sa" for m in (10, 20)) + "), qb AS (" + " UNION ALL ".join(f"SELECT series, {m} AS lags, {_q('b', m)} AS q, {_tail(_q('b', m), m)} AS p FROM sb" for m in (10, 20)) + "), o AS (SELECT series, 1.96 / sqrt(n) AS band, " + " + ".join(f"CAST(abs(c{k} / v) > 1.96 / sqrt(n) AS BIGINT)" for k in range(1, 61)) + " AS n_outside FROM sa) SELECT qa.series, qa.lags, round(qa.q, 4) AS q, qa.n, round(least(qa.p, 1), 6) AS p, round(qb.q, 4) AS q_squared, round(least(qb.p, 1), 6) AS p_squared, round(band, 6) AS band, n_outside, 3.0 AS expected_outside, min(qa.p) OVER (PARTITION BY qa.series) > 0.05 AS white_noise FROM qa JOIN qb ON qa.series = qb.series AND qa.lags = qb.lags JOIN o ON o.series = qa.series"


@query(_WHITE.replace("3.0 AS expected", "CAST(3 AS DOUBLE) AS expected"))
def white_noise(spark, d):
    r = features.log_returns(roles.daily(spark, d), ("level",), W())
    return rounded(econometrics.white_noise(r, "series", "dt", "level_ret", (10, 20)), q=4, q_squared=4)


_ACF = 60


@query("+ e AS (SELECT series, dt, level - avg(level) OVER (PARTITION BY series) AS e FROM daily), l AS (SELECT series, e, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY series ORDER BY dt) AS e{k}" for k in range(1, _ACF + 1)) + " FROM e), s AS (SELECT series, sum(e * e) AS v, " + ", ".join(f"sum(e * e{k}) AS c{k}" for k in range(1, _ACF + 1)) + " FROM l GROUP BY 1) " + " UNION ALL ".join(f"SELECT series, {k} AS lag, round(c{k} / v, 6) AS rho FROM s" for k in range(1, _ACF + 1)))
def autocorrelations(spark, d):
    return rounded(econometrics.autocorrelation(roles.daily(spark, d), "series", "dt", "level", _ACF).select("series", "lag", "rho"))


@query()
def correlogram(spark, d):
    return rounded(econometrics.correlogram(roles.daily(spark, d), "series", "dt", "level"))


@query()
def quick_adf(spark, d):
    return rounded(econometrics.adf_by_key(roles.daily(spark, d), "series", "dt", "level").withColumn("stationary", F.col("p") < 0.05))


_RET = "r AS (SELECT a.dt, ln(a.x) - lag(ln(a.x)) OVER (ORDER BY a.dt) AS x, ln(a.y) - lag(ln(a.y)) OVER (ORDER BY a.dt) AS y, ln(a.volume) - lag(ln(a.volume)) OVER (ORDER BY a.dt) AS volume FROM both_legs a)"


@query("+ " + _RET + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho, round(skewness({a}), 5) AS skew_a FROM r" for a, b in (("x", "y"), ("x", "volume"), ("y", "volume"))))
def return_correlations(spark, d):
    names = ("x", "y", "volume")
    r = features.log_returns(roles.both_legs(spark, d), names, W()).select(*[F.col(f"{c}_ret").alias(c) for c in names])
    skew = r.agg(F.array(*[F.struct(F.lit(c).alias("a"), profile.sample_skew(c).alias("skew_a")) for c in names]).alias("s")).select(F.inline("s"))
    return rounded(regimes.correlation_matrix(r, names).join(skew, "a"), skew_a=5)


@query("+ " + _RET + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM r" for a, b in (("x", "y"), ("x", "volume"), ("y", "volume"))) + ") SELECT a, b, round(rho, 6) AS rho FROM p ORDER BY -abs(round(rho, 9)), a, b LIMIT 1")
def worst_pair(spark, d):
    names = ("x", "y", "volume")
    r = features.log_returns(roles.both_legs(spark, d), names, W()).select(*[F.col(f"{c}_ret").alias(c) for c in names])
    return rounded(profile.worst_pair(regimes.correlation_matrix(r, names)))


# ---------------------------------------------------------------- regimes and models


def _regime_features(spark, d, include=regimes.FEATURES, **settings):
    return regimes.regime_features(roles.both_legs(spark, d), "series", "dt", "x", "y", rank=252, include=include, **settings)


_THREE = ("log_vol", "vol_ratio", "trend_z")


def _agg(agg: str, n: int) -> str:
    return f"{agg} {FRAME.format(n - 1)}"


_REGIME = "c0 AS (SELECT series, dt, x, y, volume, coalesce(x - lag(x) OVER o, 0) AS d, coalesce(y - lag(y) OVER o, 0) AS e, ln(nullif(volume, 0)) AS lo, row_number() OVER o AS rn FROM both_legs WINDOW o AS (PARTITION BY series ORDER BY dt)), c1 AS (SELECT *, sum(d) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) AS c FROM c0), c2 AS (SELECT *, c - lag(c, 5) OVER o AS k, lo - lag(lo, 21) OVER o AS oc, " + roll_sql("stddev_samp", "d", 63) + " AS s63, " + roll_sql("stddev_samp", "d", 21) + " AS s21, list(round(x, 9)) " + FRAME.format(251) + " AS a FROM c1 WINDOW o AS (PARTITION BY series ORDER BY dt)), rf AS (SELECT series, dt, ln(s63 * sqrt(252)) AS log_vol, ln(s21 / s63) AS vol_ratio, " + roll_sql("sum", "d", 63) + " / (s63 * sqrt(63)) AS trend_z, " + roll_sql("var_samp", "k", 63) + " / (5 * " + roll_sql("var_samp", "d", 63) + ") AS var_ratio, CASE WHEN len(a) >= 84 THEN (len(list_filter(a, lambda v: v < round(x, 9))) + (len(list_filter(a, lambda v: v = round(x, 9))) + 1) / 2) / len(a) END AS level_pctl, CASE WHEN rn >= 63 THEN " + _agg("corr(d, e)", 63) + " END AS leg_corr, " + z_sql("oc", 252) + " AS oi_trend, (c - " + roll_sql("max", "c", 126) + ") / (s63 * sqrt(63)) AS drawdown_z FROM c2)"
_HAVE = " AND ".join(f"{c} IS NOT NULL" for c in regimes.FEATURES)


@query("+ " + _REGIME + " SELECT series, dt, " + ", ".join(f"round({c}, 5) AS {c}" for c in regimes.FEATURES) + " FROM rf WHERE " + _HAVE)
def regime_features(spark, d):
    return rounded(_regime_features(spark, d), **{c: 5 for c in regimes.FEATURES})


@query("+ " + _REGIME + " SELECT series, dt, round(oi_trend, 5) AS oi_trend, round(drawdown_z, 5) AS drawdown_z FROM rf WHERE oi_trend IS NOT NULL AND drawdown_z IS NOT NULL")
def regime_features_optional(spark, d):
    return rounded(_regime_features(spark, d, regimes.OPTIONAL, oi="volume"), oi_trend=5, drawdown_z=5)


@query("+ " + _REGIME + ", g AS (SELECT * FROM rf WHERE " + _HAVE + ") " + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS rho FROM g GROUP BY series" for i, a in enumerate(regimes.FEATURES) for b in regimes.FEATURES[i + 1 :]))
def feature_diagnostics(spark, d):
    return rounded(regimes.correlation_matrix(_regime_features(spark, d), regimes.FEATURES, ("series",)), rho=5)


@query()
def variance_inflation(spark, d):
    return rounded(regimes.diagnostics(_regime_features(spark, d), regimes.FEATURES, "series"), vif=5)


@query("+ " + _REGIME + ", g AS (SELECT * FROM rf WHERE " + _HAVE + "), long AS (" + " UNION ALL ".join(f"SELECT series, '{c}' AS f, dt, {c} AS v FROM g" for c in regimes.FEATURES) + "), e AS (SELECT series, f, row_number() OVER w AS r, v - avg(v) OVER (PARTITION BY series, f) AS e FROM long WINDOW w AS (PARTITION BY series, f ORDER BY dt)), n AS (SELECT series, f, count(*) AS n, sum(e * e) AS v FROM e GROUP BY 1, 2), rho AS (SELECT a.series, a.f, b.r - a.r AS k, round(sum(a.e * b.e) / any_value(n.v), 9) AS rho FROM e a JOIN e b ON a.series = b.series AND a.f = b.f AND b.r > a.r AND b.r < a.r + 500 JOIN n ON n.series = a.series AND n.f = a.f AND b.r - a.r < n.n - 1 GROUP BY 1, 2, 3), st AS (SELECT series, f, min(k) AS stop FROM rho WHERE rho <= 0 GROUP BY 1, 2), t AS (SELECT n.series, n.f, n.n, 1 + 2 * coalesce(sum(rho.rho) FILTER (stop IS NULL OR k < stop), 0) AS t FROM n LEFT JOIN rho ON rho.series = n.series AND rho.f = n.f LEFT JOIN st ON st.series = n.series AND st.f = n.f GROUP BY 1, 2, 3) SELECT series, max(n) AS n, round(avg(t), 5) AS tau, round(max(n) / avg(t), 4) AS n_eff FROM t GROUP BY 1")
def effective_feature_rows(spark, d):
    return rounded(regimes.effective_rows(_regime_features(spark, d), "series", "dt", regimes.FEATURES), tau=5, n_eff=4)


@query("+ " + _REGIME + ", g AS (SELECT * FROM rf WHERE " + _HAVE + ") SELECT series, dt, " + ", ".join(f"round(coalesce(({c} - avg({c}) OVER (PARTITION BY series)) / nullif(stddev_pop({c}) OVER (PARTITION BY series), 0), 0), 6) AS {c}" for c in regimes.FEATURES) + " FROM g")
def standardized_features(spark, d):
    return rounded(regimes.standardized(_regime_features(spark, d), "series", regimes.FEATURES))


@query()
def regime_centres(spark, d):
    return rounded(regimes.regime_centres(_regime_features(spark, d), "series", "dt", _THREE, 3))


@query()
def assignment_confidence(spark, d):
    fit = regimes.fit_regimes(_regime_features(spark, d), "series", "dt", _THREE, 3)
    return rounded(regimes.confidence(fit, ["p0", "p1", "p2"], keys=("series",)))


@query()
def label_stability_summary(spark, d):
    draws = regimes.label_stability(_regime_features(spark, d), "series", "dt", _THREE, 2, seeds=15, samples=25)
    return rounded(regimes.stability_summary(draws, ("series",)))


@query()
def reliability_battery(spark, d):
    return rounded(regimes.reliability_battery(_regime_features(spark, d), "series", "dt", _THREE))


@query()
def configuration_sweep(spark, d):
    return rounded(regimes.configuration_sweep(roles.both_legs(spark, d), "series", "dt", "x", "y"))


@query()
def insample_against_walk_forward(spark, d):
    return rounded(_both_labels(spark, d)[0])


def _both_labels(spark, d):
    f = materialize(_regime_features(spark, d), "features")
    inside = regimes.fit_regimes(f, "series", "dt", _THREE, 2).select("series", "dt", F.col("regime").alias("insample"))
    ahead = regimes.walk_forward_labels(f, "series", "dt", _THREE, 2, lookback=504, every=126).select("series", "dt", F.col("regime").alias("ahead"))
    return regimes.compare_labels(inside.join(ahead, ["series", "dt"]), "insample", "ahead", ("series",))


@query()
def regime_confusion(spark, d):
    return rounded(_both_labels(spark, d)[1])


@query("+ " + _STATE + ", p AS (SELECT *, CASE WHEN level > avg(level) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) THEN 'high' ELSE 'low' END AS slow FROM l), c AS (SELECT series, state, slow, count(*) AS n FROM p WHERE state IS NOT NULL GROUP BY 1, 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY series, state), 6) AS share FROM c")
def label_confusion(spark, d):
    both = _states(spark, d).withColumn("slow", F.when(F.col("level") > F.avg("level").over(R.last_rows(W(), 60)), "high").otherwise("low"))
    return rounded(regimes.compare_labels(both, "state", "slow", ("series",))[1])


def _walk(spark, d, **settings):
    return model.run_walk_forward(_screened(spark, d), "series", "dt", ("lz", "vz"), "t5", 3, maxIter=20, stepSize=0.1, **settings)


@query()
def gbt_walk_forward(spark, d):
    return rounded(_walk(spark, d)[0])


@query()
def gbt_fold_table(spark, d):
    """Folds with parameters chosen on the tail of their training rows."""
    grid = model.param_grid({"maxIter": [5, 10], "maxDepth": [2, 3]})
    return rounded(_walk(spark, d, grid=grid)[1].select("series", "fold", "n_train", "n_test", "train_end", "test_start", "test_end", "oos_ic", F.to_json("params").alias("params"), F.col("importances")["lz"].alias("importance_lz"), F.col("importances")["vz"].alias("importance_vz")))


@query()
def gbt_walk_forward_summary(spark, d):
    return rounded(_walk(spark, d)[2])


@query("+ ar AS (SELECT series, level AS y, lag(level) OVER o AS a FROM daily WINDOW o AS (PARTITION BY series ORDER BY dt)), f AS (SELECT series, regr_slope(y, a) AS b, regr_intercept(y, a) AS c, regr_sxx(y, a) AS sxx, regr_syy(y, a) * (1 - regr_r2(y, a)) / (count(a) - 2) AS s2, count(a) AS n, avg(a) AS m FROM ar WHERE a IS NOT NULL GROUP BY 1) SELECT series, 'const' AS term, round(c, 4) AS coef, round(sqrt(s2 * (1.0 / n + m * m / sxx)), 4) AS se FROM f UNION ALL SELECT series, 'lag1', round(b, 4), round(sqrt(s2 / sxx), 4) FROM f")
def autoregression_one(spark, d):
    return rounded(econometrics.autoregression(roles.daily(spark, d), "series", "dt", "level", 1), coef=4, se=4)


_HAC = "+ h AS (SELECT series, dt, x, y, row_number() OVER (PARTITION BY series ORDER BY dt) AS r FROM (SELECT series, dt, ln(volume) AS x, ln(level) AS y FROM daily)), b AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM h GROUP BY 1), u AS (SELECT h.series, r, y - a - b * x AS u0, (y - a - b * x) * x AS u1 FROM h JOIN b ON h.series = b.series), g AS (SELECT *, " + ", ".join(f"lag(u{i}, {k}) OVER o AS u{i}_{k}" for i in (0, 1) for k in range(1, 6)) + " FROM u WINDOW o AS (PARTITION BY series ORDER BY r)), m AS (SELECT series, " + ", ".join(f"sum(u{i} * u{j}) + " + " + ".join(f"{1 - k / 6!r} * (sum(u{i} * u{j}_{k}) + sum(u{i}_{k} * u{j}))" for k in range(1, 6)) + f" AS m{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1))) + " FROM g GROUP BY 1), v AS (SELECT b.*, m00, m01, m11, n * sxx - sx * sx AS d FROM b JOIN m ON b.series = m.series) SELECT series, 'const' AS term, round(a, 5) AS coef, round(a / sqrt((sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (d * d)), 3) AS t FROM v UNION ALL SELECT series, 'lv', round(b, 5), round(b / sqrt((sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (d * d)), 3) FROM v"


@query(_HAC)
def hac_regression_one(spark, d):
    df = roles.daily(spark, d).select("series", "dt", F.log("volume").alias("lv"), F.log("level").alias("ll"))
    return rounded(econometrics.hac_regression(df, "series", "dt", "ll", ("lv",), 5), coef=5, t=3)
