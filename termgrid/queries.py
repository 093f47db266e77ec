"""The registered queries of the term-structure engine and, where SQL can express one, its DuckDB SQL.

A query reads the star-schema tables in the roles of sources/roles.py and applies one operator family to the whole of
them. Results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ordered
from .functions import rolling as R
from .functions.storage import materialize
from .operators import backtest, econometrics, features, model, panel, profile, regimes, roll, screen
from .sources import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, roles_: bool = True) -> Callable:
    """Register a function under its name, with its SQL after the common table expressions of the roles."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (roles.SQL.rstrip() + (",\n" if sql.lstrip().startswith("+") else "\n") + sql.lstrip().lstrip("+")) if roles_ else sql
        return f

    return keep


def rounded(df: DataFrame, *keys: str, **digits: int) -> DataFrame:
    """Doubles to 6 digits unless said otherwise; keys as they are."""
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def spread_panel_of(spark: SparkSession, d: str) -> DataFrame:
    return panel.build_spread(roles.domestic(spark, d), roles.offshore(spark, d), roles.fx(spark, d))


def W():
    """The window of a series; needs a session, so it is made when asked for."""
    return R.over("series", "dt")
FRAME = "OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def roll_sql(agg: str, x: str, n: int) -> str:
    f = FRAME.format(n - 1)
    return f"CASE WHEN count({x}) {f} >= {n} THEN {agg}({x}) {f} END"


def z_sql(x: str, n: int) -> str:
    return f"({x} - {roll_sql('avg', x, n)}) / CASE WHEN {roll_sql('stddev_samp', x, n)} > 1e-12 THEN {roll_sql('stddev_samp', x, n)} END"


# ---------------------------------------------------------------- panel


@query("""
SELECT contract, dt, expiry, price, round(ln(price), 6) AS log_price, round(ln(price) - lag(ln(price)) OVER (PARTITION BY contract, expiry ORDER BY dt), 6) AS ret
FROM domestic WHERE price > 0""")
def panel_within_contract_returns(spark, d):
    df = panel.positive_legs(roles.domestic(spark, d), "price")
    return rounded(roll.within_contract_returns(df, "price").select("contract", "dt", "expiry", "price", "log_price", "ret"), "price")


@query("""
SELECT contract, dt, expiry, price, usd, cbot, rate, spread, round(log_spread, 6) AS log_spread FROM panel""")
def spread_panel(spark, d):
    return rounded(spread_panel_of(spark, d).select("contract", "dt", "expiry", "price", "usd", "cbot", "rate", "spread", "log_spread"), "price", "usd", "cbot", "rate", "spread")


@query("""
SELECT CAST(ts AS DATE) AS dt, round(arg_min(value, (ts, value)), 6) AS value FROM events WHERE hour(ts) = 10 GROUP BY 1""", roles_=False)
def fx_exact_hour_snap(spark, d):
    return rounded(panel.exact_hour_snap(spark.read.parquet(f"{d}/events.parquet"), "ts", "value", 10))


@query("""+
prints AS (SELECT instrument, CAST(ts AS DATE) AS dt, max(ts) AS ts, max((ts, close)) AS p FROM bars WHERE hour(ts) < 11 GROUP BY 1, 2),
cal AS (SELECT instrument, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM prints GROUP BY instrument),
filled AS (SELECT c.instrument, c.dt, last_value(p.ts IGNORE NULLS) OVER w AS ts, last_value(p.p[2] IGNORE NULLS) OVER w AS close
  FROM cal c LEFT JOIN prints p ON c.instrument = p.instrument AND c.dt = p.dt WINDOW w AS (PARTITION BY c.instrument ORDER BY c.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT instrument, dt, close, (epoch_us(CAST(dt AS TIMESTAMP)) / 3.6e9 + 10) - epoch_us(ts) / 3.6e9 AS staleness_hours FROM filled)
SELECT instrument, dt, round(close, 6) AS close, round(staleness_hours, 4) AS staleness_hours FROM s WHERE staleness_hours <= 30""")
def hourly_snap_ffill_staleness(spark, d):
    return rounded(panel.snap_before(roles.bars(spark, d), "instrument", "ts", "close"), staleness_hours=4)


@query("""
SELECT user_id, CAST(ts AS DATE) AS dt, arg_min(event_id, event_id) AS event_id, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY 1, 2""", roles_=False)
def keep_first_dedup(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.to_date("ts").alias("dt"), "event_id", "value")
    return rounded(panel.keep_first(df, ["user_id", "dt"], ["event_id"]))


@query("""+
o AS (SELECT instrument, symbol, max(ts) AS last_seen FROM bars WHERE regexp_matches(symbol, '^ZC([HKNUZ])(\\d)$') GROUP BY 1, 2),
m AS (SELECT *, CASE substr(symbol, 3, 1) WHEN 'H' THEN 3 WHEN 'K' THEN 5 WHEN 'N' THEN 7 WHEN 'U' THEN 9 ELSE 12 END AS month, CAST(substr(symbol, 4, 1) AS INTEGER) AS digit FROM o)
SELECT instrument, symbol, (SELECT CAST(min(y.y) AS VARCHAR) FROM range(2000, 2061) y(y) WHERE y.y % 10 = digit AND y.y * 12 + month >= year(last_seen) * 12 + month(last_seen)) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS expiry FROM m""")
def symbol_expiry_resolution(spark, d):
    seen = panel.outright_symbols(roles.bars(spark, d)).groupBy("instrument", "symbol").agg(F.max("ts").alias("last_seen"))
    return seen.select("instrument", "symbol", panel.resolve_expiry(F.col("symbol"), F.col("last_seen")).alias("expiry"))


@query("""+
g AS (SELECT a.dt, a.expiry, a.price AS one, b.price AS other, a.price - b.price AS grade_spread, a.expiry AS series FROM domestic a JOIN domestic b ON a.dt = b.dt AND a.expiry = b.expiry WHERE a.contract = 'A' AND b.contract = 'N')
SELECT dt, expiry, one, other, grade_spread, round(""" + z_sql("grade_spread", 10) + """, 6) AS grade_z,
grade_spread - lag(grade_spread) OVER (PARTITION BY series ORDER BY dt) AS grade_change FROM g""")
def two_grade_spread_panel(spark, d):
    return rounded(panel.two_grades(roles.domestic(spark, d), "A", "N"), "one", "other", "grade_spread", "grade_change")


# ---------------------------------------------------------------- roll

_ELIGIBLE = """
lagged AS (SELECT *, lag(oi) OVER (PARTITION BY contract, expiry ORDER BY dt) AS oi_lag, CAST(expiry || '-01' AS DATE) AS first FROM panel),
elig AS (SELECT *, month(first) AS expiry_month, dense_rank() OVER (PARTITION BY contract ORDER BY dt) AS rn FROM lagged WHERE oi_lag IS NOT NULL AND dt <= CAST(first - INTERVAL 1 MONTH + INTERVAL 19 DAY AS DATE))"""
_SPINE = _ELIGIBLE + """,
spine0 AS (
  SELECT contract, CAST(0 AS BIGINT) AS rn, '' AS held FROM (SELECT DISTINCT contract FROM elig)
  UNION ALL
  SELECT s.contract, s.rn + 1, (SELECT max((e.oi_lag, e.expiry))[2] FROM elig e WHERE e.contract = s.contract AND e.rn = s.rn + 1
    AND (e.expiry >= s.held OR NOT EXISTS (SELECT 1 FROM elig h WHERE h.contract = s.contract AND h.rn = s.rn + 1 AND h.expiry = s.held)))
  FROM spine0 s WHERE s.rn < (SELECT max(rn) FROM elig e WHERE e.contract = s.contract)),
spine AS (SELECT e.contract, e.dt, e.expiry, e.expiry_month, e.oi FROM spine0 s JOIN elig e ON e.contract = s.contract AND e.rn = s.rn AND e.expiry = s.held)"""


def _spine(spark, d):
    return roll.roll_spine(spread_panel_of(spark, d))


_COMBINED = _SPINE + ", own AS (SELECT dt, expiry AS series, usd, cbot, spread FROM panel WHERE contract = 'A'), oz AS (SELECT dt, series, usd, cbot, spread, " + ", ".join(f"{z_sql(x, 20)} AS {n}" for x, n in (("spread", "arb_z"), ("usd", "own_z"), ("cbot", "cbot_z"))) + ", " + ", ".join(f"lead(usd, {h}) OVER (PARTITION BY series ORDER BY dt) - usd AS fwd_{h}" for h in (1, 5, 21)) + " FROM own), gr AS (SELECT a.dt, a.expiry AS series, a.price - b.price AS grade_spread FROM panel a JOIN panel b ON a.dt = b.dt AND a.expiry = b.expiry WHERE a.contract = 'A' AND b.contract = 'N'), gz AS (SELECT dt, series, grade_spread, " + z_sql("grade_spread", 10) + " AS grade_z, grade_spread - lag(grade_spread) OVER (PARTITION BY series ORDER BY dt) AS grade_change FROM gr)"
_HELD = ("usd", "cbot", "spread", "arb_z", "own_z", "cbot_z", "fwd_1", "fwd_5", "fwd_21", "grade_spread", "grade_z", "grade_change")


@query("+" + _COMBINED + " SELECT s.dt, s.expiry, " + ", ".join(f"round({c}, 6) AS {c}" for c in _HELD) + " FROM spine s JOIN oz ON oz.dt = s.dt AND oz.series = s.expiry LEFT JOIN gz ON gz.dt = s.dt AND gz.series = s.expiry WHERE s.contract = 'A'")
def combined_held_frame(spark, d):
    from .plans.research import build_panels, combined_frame

    return rounded(combined_frame(build_panels(roles.domestic(spark, d), roles.offshore(spark, d), roles.fx(spark, d)), "A", "N").select("dt", "expiry", *_HELD))


@query("+" + _SPINE + " SELECT contract, dt, expiry, CAST(expiry_month AS INTEGER) AS expiry_month, oi FROM spine")
def roll_spine(spark, d):
    return _spine(spark, d)


@query("+" + _ELIGIBLE + " SELECT contract, dt, max((oi_lag, expiry))[2] AS expiry FROM elig GROUP BY 1, 2")
def roll_spine_free(spark, d):
    return roll.roll_spine(spread_panel_of(spark, d), monotonic=False).select("contract", "dt", "expiry")


@query("+" + _SPINE + """, s AS (SELECT contract, expiry, lag(expiry) OVER (PARTITION BY contract ORDER BY dt) AS before FROM spine)
SELECT contract, count(*) AS n_days, count(*) FILTER (expiry <> before) AS n_rolls, count(*) FILTER (expiry < before) AS n_backward FROM s GROUP BY 1""")
def backward_roll_count(spark, d):
    s = _spine(spark, d).withColumn("before", F.lag("expiry").over(R.over("contract", "dt")))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return s.groupBy("contract").agg(F.count("*").alias("n_days"), count(F.col("expiry") != F.col("before")).alias("n_rolls"), count(F.col("expiry") < F.col("before")).alias("n_backward"))


@query("+" + _SPINE + """, own AS (SELECT *, spread - lag(spread) OVER w AS ch, log_spread - lag(log_spread) OVER w AS lch, ln(usd) - lag(ln(usd)) OVER w AS ur FROM panel WINDOW w AS (PARTITION BY contract, expiry ORDER BY dt)),
h AS (SELECT o.*, coalesce(o.expiry <> lag(o.expiry) OVER (PARTITION BY o.contract ORDER BY o.dt), true) AS is_roll FROM spine s JOIN own o ON s.contract = o.contract AND s.dt = o.dt AND s.expiry = o.expiry)
SELECT contract, dt, expiry, is_roll, round(spread, 6) AS arb_level, round(CASE WHEN NOT is_roll THEN ch END, 6) AS arb_change, round(CASE WHEN NOT is_roll THEN lch END, 6) AS log_arb_change, round(CASE WHEN NOT is_roll THEN ur END, 6) AS usd_log_return FROM h""")
def liquid_series(spark, d):
    p = spread_panel_of(spark, d)
    return rounded(roll.liquid_series(roll.roll_spine(p), p).select("contract", "dt", "expiry", "is_roll", "arb_level", "arb_change", "log_arb_change", "usd_log_return"))


@query("+" + _SPINE + """, h AS (SELECT p.* FROM spine s JOIN panel p ON s.contract = p.contract AND s.dt = p.dt AND s.expiry = p.expiry),
r AS (SELECT contract, dt, expiry, usd, spread, ln(usd) - lag(ln(usd)) OVER w AS ru, spread - lag(spread) OVER w AS ds FROM h WINDOW w AS (PARTITION BY contract, expiry ORDER BY dt))
SELECT contract, dt, expiry, round(sum(coalesce(ru, 0)) OVER o + first_value(ln(usd)) OVER o, 6) AS clog_usd, round(sum(coalesce(ds, 0)) OVER o + first_value(spread) OVER o, 4) AS c_spread
FROM r WINDOW o AS (PARTITION BY contract ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def continuous_series(spark, d):
    p = spread_panel_of(spark, d)
    held = roll.roll_spine(p).select("contract", "dt", "expiry").join(p, ["contract", "dt", "expiry"])
    return rounded(roll.continuous(held, ("usd",), ("spread",)).select("contract", "dt", "expiry", "clog_usd", "c_spread"), c_spread=4)


@query("""
SELECT contract, dt, expiry, round(spread, 6) AS spread, round(lag(spread, 1) OVER w, 6) AS spread_lag1, round(lag(spread, 2) OVER w, 6) AS spread_lag2, round(spread - lag(spread, 1) OVER w, 6) AS spread_diff FROM panel WINDOW w AS (PARTITION BY contract, expiry ORDER BY dt)""")
def within_contract_lags(spark, d):
    return rounded(roll.within_contract_lags(spread_panel_of(spark, d), "spread", 2).select("contract", "dt", "expiry", "spread", "spread_lag1", "spread_lag2", "spread_diff"))


@query("""
SELECT contract, dt, expiry, round(lead(usd, 1) OVER w - usd, 6) AS fwd_1, round(lead(usd, 5) OVER w - usd, 6) AS fwd_5, round(lead(usd, 21) OVER w - usd, 6) AS fwd_21 FROM panel WINDOW w AS (PARTITION BY contract, expiry ORDER BY dt)""")
def within_contract_forward(spark, d):
    w = R.over(["contract", "expiry"], "dt")
    return rounded(spread_panel_of(spark, d).select("contract", "dt", "expiry", *[(F.lead("usd", h).over(w) - F.col("usd")).alias(f"fwd_{h}") for h in (1, 5, 21)]))


# ---------------------------------------------------------------- features


@query("SELECT series, dt, round(level, 6) AS level, " + ", ".join(f"round(lag({c}, {k}) OVER (PARTITION BY series ORDER BY dt), 6) AS {c}_lag{k}" for c in ("level", "volume") for k in (1, 2)) + ", round(ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt), 6) AS level_ret FROM daily")
def add_lags(spark, d):
    df = features.log_returns(features.add_lags(roles.daily(spark, d), ("level", "volume"), W(), 2), ("level",), W())
    return rounded(df.select("series", "dt", "level", "level_lag1", "level_lag2", "volume_lag1", "volume_lag2", "level_ret"))


@query("+ m AS (SELECT series, dt, level, " + roll_sql("avg", "level", 20) + " AS ma FROM daily), t AS (SELECT *, level - ma AS dist FROM m) SELECT series, dt, round(ma, 6) AS level_ma_20, round(" + z_sql("dist", 60) + ", 6) AS level_ma_dist_z_20 FROM t")
def ma_distance_z(spark, d):
    return rounded(features.ma_distance(roles.daily(spark, d), "level", W(), (20,), 60).select("series", "dt", "level_ma_20", "level_ma_dist_z_20"))


def _ewm_sql(x: str, span: int) -> str:
    import math

    keep = 1 - 2 / (span + 1)
    rows = math.ceil(math.log(1e-16) / math.log(keep))
    a = f"list_reverse(list({x}) {FRAME.format(rows - 1)})"
    return f"list_sum(list_transform({a}, lambda v, i: v * power({keep!r}, i - 1))) / list_sum(list_transform({a}, lambda v, i: power({keep!r}, i - 1)))"


@query("+ m AS (SELECT series, dt, level, " + roll_sql("avg", "level", 10) + " - " + roll_sql("avg", "level", 40) + " AS c, " + _ewm_sql("level", 12) + " - " + _ewm_sql("level", 26) + " AS macd, CASE WHEN coalesce(level > " + roll_sql("avg", "level", 20) + ", false) THEN 1.0 ELSE 0.0 END AS ab FROM daily) SELECT series, dt, round(" + z_sql("c", 60) + ", 5) AS ma_cross_z, round(" + z_sql("macd", 60) + ", 5) AS macd_z, round(" + roll_sql("avg", "ab", 20) + ", 6) AS above_ma FROM m")
def ma_cross_macd_above(spark, d):
    return rounded(features.ma_momentum(roles.daily(spark, d), "level", "series", "dt", 10, 40, 20, 60).select("series", "dt", "ma_cross_z", "macd_z", "above_ma"), ma_cross_z=5, macd_z=5)


@query("+ c AS (SELECT series, dt, level - lag(level) OVER (PARTITION BY series ORDER BY dt) AS dd FROM daily), v AS (SELECT series, dt, round(" + roll_sql("stddev_samp", "dd", 20) + ", 9) AS v20 FROM c), a AS (SELECT series, dt, v20, list(v20) FILTER (v20 IS NOT NULL) " + FRAME.format(251) + " AS a FROM v) SELECT series, dt, round(v20, 6) AS vol_20, round(CASE WHEN v20 IS NOT NULL AND len(a) >= 252 THEN (len(list_filter(a, lambda x: x < v20)) + (len(list_filter(a, lambda x: x = v20)) + 1) / 2) / len(a) END, 6) AS vol_rank FROM a")
def vol_regime_rank(spark, d):
    return rounded(features.vol_regime(roles.daily(spark, d), "level", "series", "dt", (20,), 252).select("series", "dt", "vol_20", "vol_rank"))


@query("SELECT series, dt, round(volume / nullif(" + roll_sql("avg", "volume", 20) + ", 0), 6) AS volume_ratio, round(" + roll_sql("avg", "volume", 5) + " / nullif(" + roll_sql("avg", "volume", 20) + ", 0), 6) AS volume_trend, round(" + roll_sql("avg", "volume", 20) + ", 6) AS volume_ma_20, round(" + z_sql("volume", 20) + ", 6) AS volume_z_20 FROM daily")
def volume_ratio_trend(spark, d):
    df = features.volume_features(features.volume_ratios(roles.daily(spark, d), "volume", W()), "volume", W())
    return rounded(df.select("series", "dt", "volume_ratio", "volume_trend", "volume_ma_20", "volume_z_20"))


@query("SELECT series, dt, round(sin(dayofyear(dt) * (2 * pi() / 365.25)), 6) AS season_sin, round(cos(dayofyear(dt) * (2 * pi() / 365.25)), 6) AS season_cos, CAST(make_date(year(dt) + CASE WHEN month(dt) > 4 THEN 1 ELSE 0 END, 4, 1) - dt AS INTEGER) AS days_to_harvest FROM daily")
def calendar_features(spark, d):
    return rounded(features.calendar(roles.daily(spark, d), "dt").select("series", "dt", "season_sin", "season_cos", "days_to_harvest"))


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(greatest(hour(ts) * 60 + minute(ts) - 60, 0) AS INTEGER) AS minutes_since_open, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events", roles_=False)
def time_features(spark, d):
    return features.time_of_day(spark.read.parquet(f"{d}/events.parquet"), "ts").select("event_id", "hour", "minutes_since_open", "day_of_week")


@query("+ s AS (SELECT series, dt, level, level - lag(level) OVER (PARTITION BY series ORDER BY dt) AS dd FROM daily), v AS (SELECT *, " + roll_sql("stddev_samp", "dd", 20) + " AS sd FROM s) SELECT series, dt, " + ", ".join(f"lead(level, {h}) OVER w - level AS target_raw_{h}_d, round((lead(level, {h}) OVER w - level) / (CASE WHEN sd > 1e-12 THEN sd END * sqrt({h})), 6) AS target_{h}_d" for h in (1, 5, 20)) + " FROM v WINDOW w AS (PARTITION BY series ORDER BY dt)")
def forward_targets(spark, d):
    return rounded(features.forward_targets(roles.daily(spark, d), "level", W(), (1, 5, 20)).select("series", "dt", *[f"target_{r}{h}_d" for h in (1, 5, 20) for r in ("raw_", "")]), *[f"target_raw_{h}_d" for h in (1, 5, 20)])


_CHANGES = "+ c AS (SELECT series, dt, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM both_legs WINDOW w AS (PARTITION BY series ORDER BY dt))"


def _pair_sql(expr: str, n: int, both: str = "dx") -> str:
    f = FRAME.format(n - 1)
    return f"CASE WHEN count({both}) {f} >= {n} THEN {expr.replace('@', f)} END"


@query(_CHANGES + ", b AS (SELECT series, dt, dx, dy, " + _pair_sql("covar_samp(dx, dy) @ / nullif(var_samp(dy) @, 0)", 120) + " AS b, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS rn FROM c), z AS (SELECT *, last_value(CASE WHEN rn % 5 = 0 THEN b END IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beta FROM b), h AS (SELECT *, dx - lag(beta) OVER (PARTITION BY series ORDER BY dt) * dy AS hc FROM z) SELECT series, dt, round(beta, 6) AS beta, round(hc, 6) AS hedged_change, round(CASE WHEN hc IS NOT NULL THEN sum(hc) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 4) AS hedged FROM h")
def hedged_spread(spark, d):
    return rounded(features.hedged_spread(roles.both_legs(spark, d), "x", "y", W()).select("series", "dt", "beta", "hedged_change", "hedged"), hedged=4)


@query("SELECT series, dt, round(" + _pair_sql("covar_samp(x, y) @ / nullif(var_samp(y) @, 0)", 120, "x") + ", 6) AS beta FROM both_legs")
def hedge_ratio(spark, d):
    return rounded(roles.both_legs(spark, d).select("series", "dt", features.hedge_ratio("x", "y", W(), 120).alias("beta")))


@query("+ c AS (SELECT series, dt, level, lag(level) OVER w AS l, level - lag(level) OVER w AS dd, level - lag(level, 5) OVER w AS k FROM daily WINDOW w AS (PARTITION BY series ORDER BY dt)), b AS (SELECT *, covar_samp(l, dd) " + FRAME.format(58) + " / nullif(var_pop(CASE WHEN dd IS NOT NULL THEN l END) " + FRAME.format(58) + ", 0) AS b, count(level) " + FRAME.format(59) + " AS n FROM c) SELECT series, dt, round(CASE WHEN n >= 60 AND b < 0 AND b > -1 THEN -ln(2) / ln(1 + b) END, 5) AS half_life, round(" + roll_sql("var_samp", "k", 60) + " / (nullif(" + roll_sql("var_samp", "dd", 60) + ", 0) * 5), 6) AS variance_ratio FROM b")
def ou_half_life_variance_ratio(spark, d):
    return rounded(features.spread_state(roles.daily(spark, d), "level", W()).select("series", "dt", "half_life", "variance_ratio"), half_life=5)


@query(_CHANGES + " SELECT series, dt, round(" + _pair_sql("corr(dx, dy) @", 60) + ", 6) AS leg_corr, round(" + roll_sql("stddev_samp", "dx", 60) + " / nullif(" + roll_sql("stddev_samp", "dy", 60) + ", 0), 6) AS relative_vol FROM c")
def cross_leg_corr(spark, d):
    return rounded(features.cross_legs(roles.both_legs(spark, d), "x", "y", W()).select("series", "dt", "leg_corr", "relative_vol"))


# ---------------------------------------------------------------- profiles


@query("SELECT CAST(hour(ts) AS VARCHAR) AS bucket, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1 UNION ALL SELECT dayname(ts), round(avg(value), 6), round(stddev_samp(value), 6), count(value) FROM events GROUP BY 1", roles_=False)
def intraday_distribution(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return rounded(profile.distribution(e, F.hour("ts").cast("string"), "value").unionByName(profile.distribution(e, F.date_format("ts", "EEEE"), "value")))


@query("SELECT series, CAST(year(dt) AS INTEGER) AS year, " + ", ".join(f"round(avg(level) FILTER (month(dt) = {m}), 5) AS m{m}" for m in range(1, 13)) + " FROM daily GROUP BY 1, 2")
def monthly_pivot(spark, d):
    """Years are rows and months columns, so no year is left out."""
    out = profile.year_by_month(roles.daily(spark, d), "series", "dt", "level")
    return rounded(out, **{f"m{m}": 5 for m in range(1, 13)})


@query("+ r AS (SELECT series, dt, ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt) AS ret FROM daily) SELECT series, CAST(year(dt) AS INTEGER) AS year, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS std, round(CASE WHEN count(ret) > 2 THEN skewness(ret) END, 5) AS skew, round(CASE WHEN count(ret) > 3 THEN kurtosis(ret) END, 4) AS kurt FROM r GROUP BY 1, 2")
def year_moments(spark, d):
    r = features.log_returns(roles.daily(spark, d), ("level",), W()).withColumn("year", F.year("dt"))
    return rounded(profile.moments(r, ["series", "year"], "level_ret"), skew=5, kurt=4)


@query("+ n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM n")
def crosstab_share(spark, d):
    return rounded(profile.crosstab(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_linestatus"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", " + (f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(avg({c}), 4) AS mean, round(CAST(max({c}) AS DOUBLE), 4) AS max" if num else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS max") + " FROM customer" for c, num in (("c_acctbal", True), ("c_nationkey", True), ("c_mktsegment", False))), roles_=False)
def frame_profile(spark, d):
    return rounded(profile.frame_profile(spark.read.parquet(f"{d}/customer.parquet"), ("c_acctbal", "c_nationkey"), ("c_mktsegment",)), min=4, mean=4, max=4)


@query("+ s AS (SELECT series, dt, CAST(dt - lag(dt) OVER (PARTITION BY series ORDER BY dt) AS INTEGER) AS step FROM daily), c AS (SELECT series, step, count(*) AS c FROM s WHERE step IS NOT NULL GROUP BY 1, 2), m AS (SELECT series, arg_min(step, (-c, step)) AS modal_step FROM c GROUP BY 1) SELECT d.series, min(d.dt) AS first_dt, max(d.dt) AS last_dt, count(*) AS n, any_value(m.modal_step) AS modal_step, CAST((SELECT coalesce(sum(c.c), 0) FROM c WHERE c.series = d.series AND c.step > any_value(m.modal_step)) AS BIGINT) AS n_gaps FROM daily d JOIN m ON d.series = m.series GROUP BY d.series".replace("(SELECT coalesce(sum(c.c), 0) FROM c WHERE c.series = d.series AND c.step > any_value(m.modal_step))", "any_value((SELECT coalesce(sum(c.c), 0) FROM c JOIN m mm ON c.series = mm.series WHERE c.series = d.series AND c.step > mm.modal_step))"))
def date_steps(spark, d):
    return profile.date_steps(roles.daily(spark, d), "series", "dt")


@query("+ r AS (SELECT series, dt, ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt) AS ret FROM daily) SELECT series, dt + CAST((12 - isodow(dt)) % 7 AS INTEGER) AS week_end, round(sum(ret), 6) AS level_ret FROM r GROUP BY 1, 2 HAVING sum(ret) IS NOT NULL")
def weekly_returns(spark, d):
    return rounded(profile.weekly(features.log_returns(roles.daily(spark, d), ("level",), W()), "series", "dt", "level_ret"))


@query("+ c AS (SELECT series, dt, x, CASE WHEN dt IN (SELECT dt FROM both_legs WHERE y > x) THEN NULL ELSE x END AS v, row_number() OVER (PARTITION BY series ORDER BY dt) AS r FROM both_legs), n AS (SELECT series, count(*) AS n, count(*) - count(v) AS n_gaps FROM c GROUP BY 1), e AS (SELECT series, r FROM c WHERE v IS NULL UNION ALL SELECT series, 0 FROM n UNION ALL SELECT series, n + 1 FROM n), d AS (SELECT series, r - lag(r) OVER (PARTITION BY series ORDER BY r) AS d FROM e) SELECT n.series, n, n_gaps, max(d) AS longest_clean, round(n_gaps / n, 6) AS gap_share FROM n JOIN d ON n.series = d.series GROUP BY ALL")
def gap_report(spark, d):
    df = roles.both_legs(spark, d).withColumn("v", F.when(~(F.col("y") > F.col("x")), F.col("x")))
    return rounded(profile.gap_report(df, "series", "dt", "v"))


@query("+ b AS (SELECT series, level, min(level) OVER w AS a, max(level) OVER w AS z FROM daily WINDOW w AS (PARTITION BY series)) SELECT series, CAST(least(floor((level - a) / (z - a) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2")
def histogram(spark, d):
    return profile.histogram(roles.daily(spark, d), "level", 20, "series")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT CAST(ts AS DATE) AS dt, " + ", ".join(f"round(arg_min(value, event_id) FILTER (event_type = '{t}'), 6) AS {t}_open, round(max(value) FILTER (event_type = '{t}'), 6) AS {t}_high, round(min(value) FILTER (event_type = '{t}'), 6) AS {t}_low, round(arg_max(value, event_id) FILTER (event_type = '{t}'), 6) AS {t}_close" for t in _TYPES) + " FROM events GROUP BY 1", roles_=False)
def ohlcv_wide(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    long = e.groupBy(F.to_date("ts").alias("dt"), "event_type").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))
    return rounded(profile.ohlcv_wide(long, "dt", "event_type", list(_TYPES), ("open", "high", "low", "close")))


_LABEL = "CASE WHEN level > avg(level) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 'high' ELSE 'low' END"


def _labelled(spark, d):
    return roles.daily(spark, d).withColumn("state", F.when(F.col("level") > F.avg("level").over(R.last_rows(W(), 20)), "high").otherwise("low"))


@query("+ l AS (SELECT series, dt, " + _LABEL + " AS state FROM daily), c AS (SELECT *, coalesce(CAST(state <> lag(state) OVER (PARTITION BY series ORDER BY dt) AS INTEGER), 0) AS ch FROM l), s AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) AS spell FROM c), p AS (SELECT series, spell, state, count(*) AS length FROM s GROUP BY 1, 2, 3), t AS (SELECT series, sum(length) AS t, (count(*) - 1) / nullif(sum(length) - 1, 0) AS switch_rate FROM p GROUP BY 1) SELECT p.series, state, count(*) AS n_spells, round(avg(length), 6) AS mean_length, round(median(length), 6) AS median_length, max(length) AS max_length, round(any_value(switch_rate), 6) AS switch_rate, round(sum(length) / any_value(t), 6) AS occupancy FROM p JOIN t ON p.series = t.series GROUP BY 1, 2")
def spells(spark, d):
    return rounded(profile.persistence(_labelled(spark, d), "series", "dt", "state"))


def _response_sql(key: str, table: str) -> str:
    return f"SELECT series, {key}, count(*) AS n, round(avg(level), 5) AS level_mean, round(corr(level, ch), 6) AS level_change_corr, round(avg(fwd), 5) AS fwd_mean, round(stddev_samp(fwd), 5) AS fwd_sd, round(avg(fwd) / nullif(stddev_samp(fwd), 0) * sqrt(count(fwd)) / sqrt(20), 5) AS t_adj, round(quantile_cont(fwd, 0.1), 5) AS p10, round(quantile_cont(fwd, 0.9), 5) AS p90, round(avg(CASE WHEN fwd > 100 THEN 1.0 WHEN fwd IS NOT NULL THEN 0.0 END), 6) AS share_above, round(avg(CASE WHEN fwd < -100 THEN 1.0 WHEN fwd IS NOT NULL THEN 0.0 END), 6) AS share_below, round(max(fwd), 5) AS fwd_max, round(min(fwd), 5) AS fwd_min FROM {table} WHERE {key} IS NOT NULL GROUP BY 1, 2"


_FWD = "+ c AS (SELECT series, dt, level, coalesce(level - lag(level) OVER (PARTITION BY series ORDER BY dt), 0) AS ch FROM daily), f AS (SELECT *, CAST(month(dt) AS INTEGER) AS month, CASE WHEN count(ch) OVER w >= 20 THEN sum(ch) OVER w END AS fwd FROM c WINDOW w AS (PARTITION BY series ORDER BY dt ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))"
_FIVE = {c: 5 for c in ("level_mean", "fwd_mean", "fwd_sd", "t_adj", "p10", "p90", "fwd_max", "fwd_min")}


def _forward(spark, d):
    df = roles.daily(spark, d).withColumn("ch", F.coalesce(F.col("level") - F.lag("level").over(W()), F.lit(0.0)))
    return df.withColumns({"month": F.month("dt"), "fwd": R.forward_sum(F.col("ch"), W(), 20)})


@query(_FWD + _response_sql("month", "f"))
def conditional_response_month(spark, d):
    return rounded(profile.conditional_response(_forward(spark, d), ["series", "month"], "level", "ch", "fwd", 20, 100), **_FIVE)


def _bucket_sql(rank: str) -> str:
    return rank + ", e AS (SELECT series, quantile_cont(rk, [0.2, 0.4, 0.6, 0.8]) AS e FROM r GROUP BY 1), q AS (SELECT r.*, CASE WHEN rk IS NOT NULL THEN 'Q' || CAST(len(list_filter(e, lambda x: x < rk)) + 1 AS VARCHAR) END AS bucket FROM r JOIN e ON r.series = e.series) " + _response_sql("bucket", "q")


def _rank_sql(frame: str, least: int) -> str:
    return _FWD + ", a AS (SELECT *, round(level, 9) AS lv, list(round(level, 9)) " + frame + " AS a FROM f), r AS (SELECT *, CASE WHEN len(a) >= " + str(least) + " THEN round((len(list_filter(a, lambda x: x < lv)) + (len(list_filter(a, lambda x: x = lv)) + 1) / 2) / len(a), 9) END AS rk FROM a)"


def _buckets(ranked):
    ranked = materialize(ranked.withColumn("rk", F.round("rk", 9)), "ranked")  # read by four plans
    return rounded(profile.conditional_response(profile.quantile_buckets(ranked, "rk", 5, "series"), ["series", "bucket"], "level", "ch", "fwd", 20, 100), **_FIVE)


@query(_bucket_sql(_rank_sql(FRAME.format(251), 84)))
def level_quintiles(spark, d):
    return _buckets(ordered.trailing_rank(_forward(spark, d).withColumn("lv", F.round("level", 9)), "series", "dt", "lv", "rk", 252, 84))


@query(_bucket_sql(_rank_sql(FRAME.format("UNBOUNDED"), 252)))
def expanding_quintiles(spark, d):
    return _buckets(ordered.expanding_rank(_forward(spark, d).withColumn("lv", F.round("level", 9)), "series", "dt", "lv", "rk", 252))


@query("+ l AS (SELECT series, dt, " + _LABEL + " AS state, coalesce(ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt), 0) / 100 AS ret FROM daily), e AS (SELECT *, exp(sum(ret) OVER (PARTITION BY series, state ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS eq FROM l), g AS (SELECT *, eq / max(eq) OVER (PARTITION BY series, state ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e), t AS (SELECT series, state, count(*) AS n, avg(ret) * 252 AS ann_ret, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, skewness(ret) AS skew, kurtosis(ret) AS kurt, min(dd) AS max_drawdown FROM g GROUP BY 1, 2) SELECT series, state, n, round(ann_ret, 5) AS ann_ret, round(ann_vol, 5) AS ann_vol, round(sharpe, 5) AS sharpe, round(hit_rate, 6) AS hit_rate, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round(max_drawdown, 5) AS max_drawdown, round(n / sum(n) OVER (PARTITION BY series), 6) AS share FROM t")
def profile_by_state(spark, d):
    df = _labelled(spark, d).withColumn("ret", F.coalesce(F.log("level") - F.lag(F.log("level")).over(W()), F.lit(0.0)) / 100)
    return rounded(profile.regime_profile(df, "state", "ret", "dt", "series"), ann_ret=5, ann_vol=5, sharpe=5, skew=4, kurt=4, max_drawdown=5)


# ---------------------------------------------------------------- screen

_SCREEN = "+ c0 AS (SELECT series, dt, level, volume, level - lag(level) OVER (PARTITION BY series ORDER BY dt) AS dd FROM daily), c AS (SELECT series, dt, " + z_sql("level", 20) + " AS lz, " + z_sql("volume", 20) + " AS vz, lead(level, 1) OVER (PARTITION BY series ORDER BY dt) - level AS t1, lead(level, 5) OVER (PARTITION BY series ORDER BY dt) - level AS t5 FROM c0), pr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, series, dt, round({f}, 9) AS x, round({t}, 9) AS y FROM c WHERE {f} IS NOT NULL AND {t} IS NOT NULL" for f in ("lz", "vz") for t in ("t1", "t5")) + "), rk AS (SELECT series, feature, target, dt, rank() OVER (PARTITION BY series, feature, target ORDER BY x) + (count(*) OVER (PARTITION BY series, feature, target, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY series, feature, target ORDER BY y) + (count(*) OVER (PARTITION BY series, feature, target, y) - 1) / 2 AS ry FROM pr)"


def _screened(spark, d):
    return roles.daily(spark, d).withColumns({"lz": R.zscore(F.col("level"), W(), 20), "vz": R.zscore(F.col("volume"), W(), 20), **{f"t{h}": F.lead("level", h).over(W()) - F.col("level") for h in (1, 5)}})


@query(_SCREEN + " SELECT series, feature, target, round(corr(rx, ry), 6) AS ic, count(*) AS n FROM rk GROUP BY 1, 2, 3")
def rank_ic(spark, d):
    return rounded(screen.rank_ic(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5")))


_NW = _SCREEN + ", z AS (SELECT series, feature, target, dt, (rx - avg(rx) OVER g) / stddev_samp(rx) OVER g AS zx, (ry - avg(ry) OVER g) / stddev_samp(ry) OVER g AS zy FROM rk WINDOW g AS (PARTITION BY series, feature, target)), b AS (SELECT *, sum(zx * zy) OVER g / sum(zx * zx) OVER g AS b FROM z WINDOW g AS (PARTITION BY series, feature, target)), u AS (SELECT *, (zy - b * zx) * zx AS u FROM b), l AS (SELECT *, " + ", ".join(f"lag(u, {k}) OVER o AS u{k}" for k in range(1, 6)) + " FROM u WINDOW o AS (PARTITION BY series, feature, target ORDER BY dt)), nw AS (SELECT series, feature, target, any_value(b) AS slope, any_value(b) / (sqrt(sum(u * u) + " + " + ".join(f"{2 * (1 - k / 6)!r} * sum(u * u{k})" for k in range(1, 6)) + ") / sum(zx * zx)) AS t, count(*) AS n FROM l GROUP BY 1, 2, 3)"


@query(_NW + " SELECT series, feature, target, round(slope, 6) AS slope, round(t, 5) AS t, n FROM nw")
def nw_t(spark, d):
    return rounded(screen.nw_t(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"), 5), t=5)


@query(_NW + f", s AS (SELECT series, feature, max((round(abs(t), 9), target))[2] AS target FROM nw GROUP BY 1, 2) SELECT s.series, s.feature, s.target, round(nw.t, 5) AS t, abs(nw.t) >= {screen.bonferroni_bar(4)!r} AS survives FROM s JOIN nw ON s.series = nw.series AND s.feature = nw.feature AND s.target = nw.target")
def screen_survivors(spark, d):
    scores = screen.nw_t(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"), 5)
    return rounded(screen.best_horizon(scores, "series", screen.bonferroni_bar(4)), t=5)


@query(_NW + " SELECT series, target, CAST(count(*) FILTER (abs(t) >= 2) AS BIGINT) AS n_strong, round(avg(abs(t)), 5) AS mean_abs_t, round(max(abs(t)), 5) AS max_abs_t FROM nw GROUP BY 1, 2")
def screen_breadth(spark, d):
    return rounded(screen.breadth(screen.nw_t(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"), 5), "series"), mean_abs_t=5, max_abs_t=5)


@query(_SCREEN + " SELECT series, feature, round(max(CASE WHEN target = 't1' THEN ic END), 6) AS t1, round(max(CASE WHEN target = 't5' THEN ic END), 6) AS t5 FROM (SELECT series, feature, target, corr(rx, ry) AS ic FROM rk GROUP BY 1, 2, 3) GROUP BY 1, 2")
def ic_decay(spark, d):
    ic = screen.rank_ic(_screened(spark, d), "series", "dt", ("lz", "vz"), ("t1", "t5"))
    return rounded(ic.groupBy("series", "feature").agg(*[F.max(F.when(F.col("target") == t, F.col("ic"))).alias(t) for t in ("t1", "t5")]))


@query("+ p AS (SELECT round(x, 9) AS x, round(y, 9) AS y, round(volume, 9) AS volume FROM both_legs), " + ", ".join(f"{a}_{b} AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM p)" for a in ("x", "y", "volume") for b in ("x", "y", "volume")) + " " + " UNION ALL ".join(f"SELECT 'pair' AS series, '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho FROM {a}_{b}" for a in ("x", "y", "volume") for b in ("x", "y", "volume")))
def feature_correlation(spark, d):
    return rounded(screen.feature_correlation(roles.both_legs(spark, d), "series", "dt", ("x", "y", "volume")))


@query()
def greedy_prune(spark, d):
    """Names that stay after the prune; the correlations of a few columns are gathered, not rows."""
    df, rows = _screened(spark, d), []
    scores, pairs = screen.nw_t(df, "series", "dt", ("lz", "vz"), ("t1",), 5).collect(), screen.feature_correlation(df, "series", "dt", ("lz", "vz")).collect()
    for name in sorted({r["series"] for r in scores}):
        rho = {(r["a"], r["b"]): r["rho"] for r in pairs if r["series"] == name}
        rows += [(name, n, k) for k, n in enumerate(screen.greedy_prune({r["feature"]: r["t"] for r in scores if r["series"] == name}, rho))]
    return spark.createDataFrame(rows, "series string, feature string, place int")


# ---------------------------------------------------------------- performance

_PNL = "+ s AS (SELECT series, dt, level, ln(level) - lag(ln(level)) OVER (PARTITION BY series ORDER BY dt) AS lr, " + z_sql("level", 20) + " AS sig FROM daily), p0 AS (SELECT series, dt, sig, lead(lr, 1) OVER (PARTITION BY series ORDER BY dt) / 50 AS fwd FROM s), p AS (SELECT series, dt, sign(sig) * fwd AS pnl, (row_number() OVER (PARTITION BY series ORDER BY dt) - 1) % 5 AS o FROM p0 WHERE sig IS NOT NULL AND fwd IS NOT NULL)"


def _traded(spark, d):
    df = features.log_returns(roles.daily(spark, d), ("level",), W()).withColumn("sig", R.zscore(F.col("level"), W(), 20))
    return df.withColumn("fwd", F.lead("level_ret", 1).over(W()) / 50)


@query(_PNL + ", e AS (SELECT *, product(1 + pnl) OVER w AS eq FROM p WINDOW w AS (PARTITION BY series, o ORDER BY dt ROWS UNBOUNDED PRECEDING)), g AS (SELECT *, eq / max(eq) OVER (PARTITION BY series, o ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e), t AS (SELECT series, o, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS ev, product(1 + pnl) - 1 AS total, min(dd) AS max_drawdown, avg(pnl) / stddev_samp(pnl) * sqrt(50.4) AS sharpe, avg(pnl) / sqrt(avg(power(least(pnl, 0), 2))) * sqrt(50.4) AS sortino, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS t FROM g GROUP BY 1, 2) SELECT series, count(*) AS n_offsets, round(avg(n), 4) AS n, round(avg(win_rate), 6) AS win_rate, round(avg(ev), 6) AS ev, round(avg(total), 5) AS total, round(avg(max_drawdown), 5) AS max_drawdown, round(avg(sharpe), 5) AS sharpe, round(avg(sortino), 5) AS sortino, round(avg(t), 5) AS t, round(min(sharpe), 5) AS sharpe_min, round(max(sharpe), 5) AS sharpe_max FROM t GROUP BY 1")
def perf_stats_offsets(spark, d):
    out = backtest.performance(_traded(spark, d), "series", "dt", "sig", "fwd", 5)
    five = ("total", "max_drawdown", "sharpe", "sortino", "t", "sharpe_min", "sharpe_max")
    return rounded(out.select("series", "n_offsets", "n", "win_rate", "ev", *five), n=4, **{c: 5 for c in five})


@query(_PNL + ", e AS (SELECT *, product(1 + pnl) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity FROM p) SELECT series, dt, round(equity, 5) AS equity, round(equity / max(equity) OVER (PARTITION BY series ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1, 5) AS drawdown FROM e")
def drawdown(spark, d):
    t = _traded(spark, d).filter("sig is not null and fwd is not null").withColumn("pnl", F.signum("sig") * F.col("fwd"))
    return rounded(backtest.equity(t, ["series"], "dt", "pnl").select("series", "dt", "equity", "drawdown"), equity=5, drawdown=5)


@query(_PNL + " SELECT series, round(avg(pnl), 6) AS mean, round(stddev_samp(pnl), 6) AS std, round(power(product(1 + pnl), 252.0 / count(pnl)) - 1, 5) AS annual_return, round(stddev_samp(pnl) * sqrt(252), 5) AS annual_vol, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) AS sharpe FROM p GROUP BY 1")
def sharpe(spark, d):
    t = _traded(spark, d).filter("sig is not null and fwd is not null").withColumn("pnl", F.signum("sig") * F.col("fwd"))
    return rounded(backtest.sharpe(t, "series", "pnl"), annual_return=5, annual_vol=5, sharpe=5)


_FOLDS = backtest.walk_forward_folds(2000, 6, 200, 5)


@query("+ r AS (SELECT series, dt, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS rn FROM daily), f(fold, a, b, c) AS (VALUES " + ", ".join(map(str, _FOLDS)) + ") SELECT series, CAST(fold AS INTEGER) AS fold, max(CASE WHEN rn < a THEN dt END) AS train_end, min(CASE WHEN rn >= b THEN dt END) AS test_start, max(CASE WHEN rn >= b THEN dt END) AS test_end, count(*) FILTER (rn < a) AS n_train, count(*) FILTER (rn >= b) AS n_test FROM r JOIN f ON rn < c GROUP BY 1, 2")
def walk_forward_folds(spark, d):
    return backtest.fold_table(spark, roles.daily(spark, d), "dt", _FOLDS)


# ---------------------------------------------------------------- econometrics


@query("SELECT contract || ' ' || expiry AS key, round(regr_intercept(log_usd, log_cbot), 5) AS alpha, round(regr_slope(log_usd, log_cbot), 6) AS beta, round(regr_r2(log_usd, log_cbot), 6) AS r2, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) >= 10")
def engle_granger(spark, d):
    return rounded(econometrics.engle_granger(spread_panel_of(spark, d).withColumn("key", F.concat_ws(" ", "contract", "expiry")), "key", "log_usd", "log_cbot", 10), alpha=5)


@query("+ e AS (SELECT regr_r2(log_usd, log_cbot) AS p FROM panel GROUP BY contract, expiry HAVING count(*) >= 10 AND regr_r2(log_usd, log_cbot) IS NOT NULL) SELECT count(p) AS n, round(sum(-2 * ln(greatest(p, 1e-10))), 4) AS stat FROM e")
def fisher(spark, d):
    fits = spread_panel_of(spark, d).groupBy("contract", "expiry").agg(F.regr_r2("log_usd", "log_cbot").alias("p"), F.count("*").alias("n")).filter("n >= 10 and p is not null")
    return rounded(econometrics.fisher(fits, "p").select("n", "stat"), stat=4)


@query("+ e AS (SELECT series, dt, level - avg(level) OVER (PARTITION BY series) AS e FROM daily), l AS (SELECT series, e, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY series ORDER BY dt) AS e{k}" for k in range(1, 11)) + " FROM e), s AS (SELECT series, count(*) AS n, sum(e * e) AS v, " + ", ".join(f"sum(e * e{k}) AS c{k}" for k in range(1, 11)) + " FROM l GROUP BY 1) " + " UNION ALL ".join(f"SELECT series, {m} AS lags, round((" + " + ".join(f"power(c{k} / v, 2) / (n - {k})" for k in range(1, m + 1)) + ") * n * (n + 2), 4) AS q, n FROM s" for m in (5, 10)))
def ljung_box_q(spark, d):
    return rounded(econometrics.ljung_box(roles.daily(spark, d), "series", "dt", "level", (5, 10)), q=4)


@query("+ e AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY dt) AS r, level - avg(level) OVER (PARTITION BY series) AS e FROM daily), n AS (SELECT series, count(*) AS n, sum(e * e) AS v FROM e GROUP BY 1), rho AS (SELECT a.series, b.r - a.r AS k, round(sum(a.e * b.e) / any_value(n.v), 9) AS rho FROM e a JOIN e b ON a.series = b.series AND b.r > a.r AND b.r < a.r + 500 JOIN n ON n.series = a.series AND b.r - a.r < n.n - 1 GROUP BY 1, 2), st AS (SELECT series, min(k) AS stop FROM rho WHERE rho <= 0 GROUP BY 1), t AS (SELECT rho.series, 1 + 2 * sum(rho) AS t FROM rho LEFT JOIN st ON rho.series = st.series WHERE stop IS NULL OR k < stop GROUP BY 1) SELECT n.series, n, round(coalesce(t, 1), 6) AS tau, round(n / coalesce(t, 1), 4) AS n_eff FROM n LEFT JOIN t ON n.series = t.series")
def effective_sample_size(spark, d):
    return rounded(regimes.effective_size(roles.daily(spark, d), "series", "dt", "level"), n_eff=4)


@query("WITH c AS (SELECT quality, toxic, count(*) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM c), r AS (SELECT sum(c * (c - 1) / 2) AS r FROM (SELECT sum(c) AS c FROM c GROUP BY quality)), k AS (SELECT sum(c * (c - 1) / 2) AS k FROM (SELECT sum(c) AS c FROM c GROUP BY toxic)) SELECT CAST(n AS BIGINT) AS n, round(coalesce((s - r * k / nullif(n * (n - 1) / 2, 0)) / nullif((r + k) / 2 - r * k / nullif(n * (n - 1) / 2, 0), 0), 1), 6) AS ari FROM s, r, k", roles_=False)
def adjusted_rand(spark, d):
    return rounded(regimes.adjusted_rand_index(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"))


@query()
def adf_by_contract(spark, d):
    p = spread_panel_of(spark, d).withColumn("key", F.concat_ws(" ", "contract", "expiry"))
    return rounded(econometrics.adf_by_key(p, "key", "dt", "log_spread"))


@query()
def coint_by_contract(spark, d):
    p = spread_panel_of(spark, d).withColumn("key", F.concat_ws(" ", "contract", "expiry"))
    return rounded(econometrics.coint_by_key(p, "key", "dt", "log_usd", "log_cbot"))




def _det(m: list[list[str]]) -> str:
    """The determinant of a small matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {x} * {_det([[v for c, v in enumerate(r) if c != j] for r in m[1:]])}" for j, x in enumerate(m[0])) + ")"


def hac_sql(rows: str, y: str, xs: tuple[str, ...], lags: int, name: str = "h") -> str:
    """Common table expressions that end in <name>_out (series, term, coef, t): normal equations by cofactors, scores, lagged products.

    rows: a table with series, dt, y and xs.
    """
    x, m = ["1.0", *xs], len(xs) + 1
    at = lambda i, j: f"{min(i, j)}_{max(i, j)}"
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    a = [[f"a{at(i, j)}" for j in range(m)] for i in range(m)]
    minor = lambda i, j: [[v for c, v in enumerate(r) if c != j] for k, r in enumerate(a) if k != i]
    inverse = ", ".join(f"{'-' if (i + j) % 2 else ''}{_det(minor(i, j))} / {_det(a)} AS v{at(i, j)}" for i, j in pairs)
    beta = ", ".join("(" + " + ".join(f"v{at(i, j)} * c{j}" for j in range(m)) + f") AS b{i}" for i in range(m))
    error = f"(y - ({' + '.join(f'b{i} * x{i}' for i in range(m))}))"
    cell = lambda i, j: f"sum(u{i} * u{j})" + "".join(f" + {1 - k / (lags + 1)!r} * coalesce(sum(u{i} * u{j}_{k}) + sum(u{i}_{k} * u{j}), 0)" for k in range(1, lags + 1))
    lagged = "".join(f", lag(u{i}, {k}) OVER (PARTITION BY series ORDER BY dt) AS u{i}_{k}" for i in range(m) for k in range(1, lags + 1))
    se = lambda i: "sqrt(" + " + ".join(f"v{at(i, j)} * m{at(j, k)} * v{at(i, k)}" for j in range(m) for k in range(m)) + ")"
    have = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    return (
        f"{name}_x AS (SELECT series, dt, {y} AS y, " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(x)) + f" FROM {rows} WHERE {have}), "
        f"{name}_s AS (SELECT series, " + ", ".join([f"sum(x{i} * x{j}) AS a{at(i, j)}" for i, j in pairs] + [f"sum(x{i} * y) AS c{i}" for i in range(m)]) + f" FROM {name}_x GROUP BY 1), "
        f"{name}_v AS (SELECT *, {inverse} FROM {name}_s), {name}_b AS (SELECT *, {beta} FROM {name}_v), "
        f"{name}_u AS (SELECT h.series, h.dt, " + ", ".join(f"{error} * x{i} AS u{i}" for i in range(m)) + f" FROM {name}_x h JOIN {name}_b b ON h.series = b.series), "
        f"{name}_l AS (SELECT *{lagged} FROM {name}_u), {name}_m AS (SELECT series, " + ", ".join(f"{cell(i, j)} AS m{at(i, j)}" for i, j in pairs) + f" FROM {name}_l GROUP BY 1), "
        f"{name}_out AS (" + " UNION ALL ".join(f"SELECT b.series, '{c}' AS term, b{i} AS coef, b{i} / {se(i)} AS t FROM {name}_b b JOIN {name}_m m ON m.series = b.series" for i, c in enumerate(("const", *xs))) + ")"
    )


def _ar_sql(lags: int) -> str:
    """Least squares of level on a constant and its lags, by cofactors."""
    m, at = lags + 1, lambda i, j: f"{min(i, j)}_{max(i, j)}"
    a = [[f"a{at(i, j)}" for j in range(m)] for i in range(m)]
    minor = lambda i, j: [[v for c, v in enumerate(r) if c != j] for k, r in enumerate(a) if k != i]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    x = ["1.0", *[f"l{k}" for k in range(1, m)]]
    return (
        "+ l AS (SELECT series, level AS y, " + ", ".join(f"lag(level, {k}) OVER (PARTITION BY series ORDER BY dt) AS l{k}" for k in range(1, m)) + " FROM daily), "
        "s AS (SELECT series, count(*) AS n, sum(y * y) AS yy, " + ", ".join([f"sum({x[i]} * {x[j]}) AS a{at(i, j)}" for i, j in pairs] + [f"sum({x[i]} * y) AS c{i}" for i in range(m)]) + f" FROM l WHERE l{lags} IS NOT NULL GROUP BY 1), "
        "v AS (SELECT *, " + ", ".join(f"{'-' if (i + j) % 2 else ''}{_det(minor(i, j))} / {_det(a)} AS v{at(i, j)}" for i, j in pairs) + " FROM s), "
        "b AS (SELECT *, " + ", ".join("(" + " + ".join(f"v{at(i, j)} * c{j}" for j in range(m)) + f") AS b{i}" for i in range(m)) + " FROM v), "
        f"e AS (SELECT *, (yy - ({' + '.join(f'b{i} * c{i}' for i in range(m))})) / (n - {m}) AS s2 FROM b) "
        + " UNION ALL ".join(f"SELECT series, '{'lag' + str(i) if i else 'const'}' AS term, round(b{i}, 4) AS coef, round(sqrt(v{at(i, i)} * s2), 4) AS se FROM e" for i in range(m))
    )


@query(_ar_sql(3))
def autoregression(spark, d):
    return rounded(econometrics.autoregression(roles.daily(spark, d), "series", "dt", "level", 3), coef=4, se=4)


@query(_SCREEN + ", " + hac_sql("c", "t5", ("lz", "vz"), 5) + " SELECT series, term, round(coef, 6) AS coef, round(t, 5) AS t FROM h_out")
def hac_regression(spark, d):
    return rounded(econometrics.hac_regression(_screened(spark, d), "series", "dt", "t5", ("lz", "vz"), 5), t=5)


@query(_SCREEN + ", g AS (SELECT *, lz * vz AS gated FROM c), " + hac_sql("g", "t5", ("lz", "vz", "gated"), 5) + ", e AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) AS k FROM g), f AS (SELECT * FROM e WHERE k % 5 = 1), " + hac_sql("f", "t5", ("lz", "vz", "gated"), 0, "w") + " SELECT 'overlapping' AS sample, series, term, round(coef, 5) AS coef, round(t, 4) AS t FROM h_out UNION ALL SELECT 'every fifth', series, term, round(coef, 5), round(t, 4) FROM w_out")
def gate_interaction(spark, d):
    """The forward move on a score, a gate and their product, over all rows with five lags and over every fifth row with none."""
    rows = _screened(spark, d).withColumn("gated", F.col("lz") * F.col("vz"))
    fit = lambda t, name, lags: econometrics.hac_regression(t, "series", "dt", "t5", ("lz", "vz", "gated"), lags).select(F.lit(name).alias("sample"), "series", "term", "coef", "t")
    fifth = ordered.numbered(rows, ["series"], "dt", "k").filter("k % 5 = 0")
    return rounded(fit(rows, "overlapping", 5).unionByName(fit(fifth, "every fifth", 0)), coef=5, t=4)


# ---------------------------------------------------------------- regimes and models


def _regime_features(spark, d):
    return regimes.regime_features(roles.both_legs(spark, d), "series", "dt", "x", "y", rank=252)


_COLUMNS = ("log_vol", "vol_ratio", "trend_z")


@query()
def gmm_select(spark, d):
    return rounded(regimes.select_components(_regime_features(spark, d), "series", "dt", _COLUMNS, tuple(range(1, 9)), ("full", "diag", "tied", "spherical")))


@query()
def fit_regimes(spark, d):
    return rounded(regimes.fit_regimes(_regime_features(spark, d), "series", "dt", _COLUMNS, 3))


@query()
def label_stability(spark, d):
    return rounded(regimes.label_stability(_regime_features(spark, d), "series", "dt", _COLUMNS, 2, seeds=15, samples=25))


@query()
def algorithm_agreement(spark, d):
    return rounded(regimes.algorithm_agreement(_regime_features(spark, d), "series", "dt", _COLUMNS, 2))


@query()
def split_stability(spark, d):
    return rounded(regimes.split_stability(_regime_features(spark, d), "series", "dt", _COLUMNS, 2))


@query()
def walk_forward_labels(spark, d):
    return rounded(_walked(spark, d))


def _walked(spark, d):
    return regimes.walk_forward_labels(_regime_features(spark, d), "series", "dt", _COLUMNS, 2, lookback=504, every=126)


@query()
def walk_forward_refits(spark, d):
    return regimes.walk_forward_summary(_walked(spark, d), "series", "dt")


@query()
def fold_centres(spark, d):
    return rounded(regimes.fold_centres(_regime_features(spark, d), "series", "dt", _COLUMNS, 2))


@query()
def gmm_best(spark, d):
    """The chosen row of the grid by the penalty at the effective size of the features."""
    f = materialize(_regime_features(spark, d), "features")
    size = {r["series"]: r["n_eff"] for r in regimes.effective_rows(f, "series", "dt", _COLUMNS).collect()}
    return rounded(regimes.select_components(f, "series", "dt", _COLUMNS, (1, 2, 3, 4), n_effective=size).filter("best"))


from . import queries_study  # noqa: E402, F401  registers the rest
