"""The star-schema tables in the roles of a futures term structure.

Each role is given twice: as a DataFrame and as a common table expression for an independent SQL engine. Money is summed
as decimals, so both start from the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18, 2)"

SQL = """
WITH RECURSIVE slot AS (
  SELECT CAST(l_shipdate AS DATE) AS dt, l_returnflag AS contract, l_linestatus AS side, CAST(l_extendedprice AS DECIMAL(18,2)) AS ep, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
    year(l_shipdate) * 12 + (quarter(l_shipdate) - 1) * 3 + 3 * (1 + (l_linenumber - 1) % 3) AS ym FROM lineitem),
slot2 AS (SELECT dt, contract, side, ep, qty, lpad(CAST(ym // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(ym % 12 + 1 AS VARCHAR), 2, '0') AS expiry FROM slot),
domestic AS (SELECT contract, dt, expiry, CAST(sum(ep) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS price, CAST(sum(qty) AS DOUBLE) AS volume, CAST(sum(qty) AS DOUBLE) AS oi
  FROM slot2 WHERE side = 'O' GROUP BY contract, dt, expiry),
offshore AS (SELECT dt, expiry, CAST(sum(ep) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS cbot, CAST(sum(qty) AS DOUBLE) AS cbot_volume FROM slot2 WHERE side = 'F' GROUP BY dt, expiry),
fx AS (SELECT CAST(o_orderdate AS DATE) AS dt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 15000 AS rate FROM orders GROUP BY 1),
panel AS (SELECT d.contract, d.dt, d.expiry, price, volume, oi, cbot, cbot_volume, rate, price / rate AS usd, price / rate - cbot AS spread,
    ln(price / rate) AS log_usd, ln(price) AS log_zar, ln(cbot) AS log_cbot, ln(price / rate) - ln(cbot) AS log_spread
  FROM domestic d JOIN offshore o ON d.dt = o.dt AND d.expiry = o.expiry JOIN fx ON fx.dt = d.dt WHERE price > 0 AND cbot > 0 AND rate > 0),
daily AS (SELECT 'lineitem' AS series, CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS level,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem GROUP BY 2
  UNION ALL SELECT 'orders', CAST(o_orderdate AS DATE), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2),
both_legs AS (SELECT 'pair' AS series, a.dt, a.level AS x, b.level AS y, a.volume FROM daily a JOIN daily b ON a.dt = b.dt WHERE a.series = 'lineitem' AND b.series = 'orders'),
bars AS (SELECT user_id AS instrument, ts, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
    CASE WHEN event_type = 'error' THEN 'ZCZ0-ZCN1' ELSE 'ZC' || substr('HKNUZ', CAST(user_id % 5 AS INTEGER) + 1, 1) || CAST(user_id % 10 AS VARCHAR) END AS symbol FROM events)
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast("double")


def slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: three delivery quarters at a time, by line number."""
    day = F.col("l_shipdate")
    ym = F.year(day) * 12 + (F.quarter(day) - 1) * 3 + 3 * (1 + (F.col("l_linenumber") - 1) % 3)
    expiry = F.concat_ws("-", F.lpad(F.floor(ym / 12).cast("string"), 4, "0"), F.lpad((ym % 12 + 1).cast("string"), 2, "0"))
    return _read(spark, sf_dir, "lineitem").select(F.to_date(day).alias("dt"), F.col("l_returnflag").alias("contract"), F.col("l_linestatus").alias("side"), expiry.alias("expiry"), "l_extendedprice", "l_quantity")


def domestic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _money("l_quantity")
    return slot(spark, sf_dir).filter("side = 'O'").groupBy("contract", "dt", "expiry").agg((_money("l_extendedprice") / q).alias("price"), q.alias("volume"), q.alias("oi"))


def offshore(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _money("l_quantity")
    return slot(spark, sf_dir).filter("side = 'F'").groupBy("dt", "expiry").agg((_money("l_extendedprice") / q).alias("cbot"), q.alias("cbot_volume"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg((_money("o_totalprice") / F.count("*") / 15000).alias("rate"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two long single series."""
    q = _money("l_quantity")
    a = _read(spark, sf_dir, "lineitem").groupBy(F.lit("lineitem").alias("series"), F.to_date("l_shipdate").alias("dt")).agg((_money("l_extendedprice") / q).alias("level"), q.alias("volume"))
    b = _read(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("series"), F.to_date("o_orderdate").alias("dt")).agg((_money("o_totalprice") / F.count("*") / 100).alias("level"), F.count("*").cast("double").alias("volume"))
    return a.unionByName(b)


def both_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    a, b = d.filter("series = 'lineitem'").select("dt", F.col("level").alias("x"), "volume"), d.filter("series = 'orders'").select("dt", F.col("level").alias("y"))
    return a.join(b, "dt").select(F.lit("pair").alias("series"), "dt", "x", "y", "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly bars; one kind of event stands for spread symbols."""
    code = F.substring(F.lit("HKNUZ"), 1, 5)
    symbol = F.concat(F.lit("ZC"), F.substr(code, (F.col("user_id") % 5 + 1).cast("int"), F.lit(1)), (F.col("user_id") % 10).cast("string"))
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("instrument"), "ts", F.col("value").alias("close"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.when(F.col("event_type") == "error", "ZCZ0-ZCN1").otherwise(symbol).alias("symbol"))
