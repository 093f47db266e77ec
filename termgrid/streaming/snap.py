"""The daily snap over a stream of bars: the last print of each date before the cut-off, with late bars bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_snap(bars: DataFrame, key: str, ts: str, value: str, cutoff_hour: int = 11, late: str = "2 days") -> DataFrame:
    """key, dt, value, last_ts for a streaming or a batch frame; a date is final once the watermark passes its end."""
    day = F.window(F.col(ts), "1 day")
    out = bars.filter(F.hour(ts) < cutoff_hour).withWatermark(ts, late).groupBy(key, day).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))).alias("p"))
    return out.select(key, F.to_date("window.start").alias("dt"), F.col("p.v").alias(value), F.col("p.t").alias("last_ts"))
