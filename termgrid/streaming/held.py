"""The roll over streams: legs joined as they arrive, and the held expiry of each contract kept as state between days.

A day is decided once the watermark has passed it, in order of the days. The state of a contract is its held expiry, the last open interest of each
expiry, and the rows of days that are not final yet. Needs a state store that keeps several states, such as RocksDB's.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 24 * 3600 * 1000


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that held_stream needs, for queries that start later in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_panel(domestic: DataFrame, offshore: DataFrame, fx: DataFrame, late: str = "2 days") -> DataFrame:
    """The positive legs of domestic (contract, dt, expiry, price, oi), offshore (dt, expiry, cbot) and fx (dt, rate), each a stream with dates dt.

    Inner joins on the date and expiry; each leg waits for the others as long as its watermark allows.
    """
    timed = lambda df, name: df.withColumn(f"{name}_at", F.col("dt").cast("timestamp")).withWatermark(f"{name}_at", late)
    d, o = timed(domestic, "d"), timed(offshore, "o").withColumnsRenamed({"dt": "o_dt", "expiry": "o_expiry"})
    x = timed(fx, "x").withColumnRenamed("dt", "x_dt")
    both = d.join(o, (F.col("dt") == F.col("o_dt")) & (F.col("expiry") == F.col("o_expiry")) & (F.col("d_at") == F.col("o_at")))
    all_ = both.join(x, (F.col("dt") == F.col("x_dt")) & (F.col("d_at") == F.col("x_at")))
    return all_.filter("price > 0 and cbot > 0 and rate > 0").select("contract", "dt", "expiry", "price", "oi", "cbot", "rate", "d_at")


class HoldByDay(StatefulProcessor):
    """Rows (contract, dt, expiry, oi) in any order within the watermark; one row a contract and final day comes out."""

    def __init__(self, months: tuple[int, ...], exit_day: int):
        self.months, self.exit_day = months, exit_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "expiry string")
        self.last = handle.getMapState("last", "expiry string", "oi double")
        self.days = handle.getMapState("days", "dt string", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[str, list] = {}
        for t in rows:
            for day, expiry, oi in zip(t["dt"], t["expiry"], t["oi"], strict=True):
                arrived.setdefault(pd.Timestamp(day).date().isoformat(), []).append((expiry, None if oi != oi else float(oi)))
        for day, found in arrived.items():
            seen = json.loads(self.days.getValue((day,))[0]) if self.days.containsKey((day,)) else []
            self.days.updateValue((day,), (json.dumps(seen + found),))
            if not seen:
                self.handle.registerTimer(int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.UTC).timestamp() * 1000) + _DAY)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000 - _DAY / 1000, dt.UTC).date()
        rows = json.loads(self.days.getValue((day.isoformat(),))[0])
        self.days.removeKey((day.isoformat(),))
        may = []
        for expiry, oi in rows:
            before = self.last.getValue((expiry,))[0] if self.last.containsKey((expiry,)) else None
            if before is not None and self._open(expiry, day):
                may.append((before, expiry, oi))
        for expiry, oi in rows:
            self.last.updateValue((expiry,), (oi,))
        if not may:
            return iter([])
        held = self.held.get()[0] if self.held.exists() else ""
        if held in [m[1] for m in may]:
            may = [m for m in may if m[1] >= held]
        _, expiry, oi = max(may, key=lambda m: m[:2])
        self.held.update((expiry,))
        return iter([pd.DataFrame({"contract": [key[0]], "dt": [day], "expiry": [expiry], "expiry_month": [int(expiry[5:7])], "oi": [oi]})])

    def _open(self, expiry: str, day: dt.date) -> bool:
        """Whether an expiry may be held on a day: one of the months, and before the exit day of the month before delivery."""
        year, month = int(expiry[:4]), int(expiry[5:7])
        first = dt.date(year - (month == 1), (month - 2) % 12 + 1, 1)
        return (not self.months or month in self.months) and day <= first + dt.timedelta(days=self.exit_day - 1)

    def close(self) -> None:
        pass


def held_stream(panel: DataFrame, months: tuple[int, ...] = (), exit_day: int = 20) -> DataFrame:
    """contract, dt, expiry, expiry_month, oi, as operators.roll.roll_spine gives them, of a stream with a watermark (see stream_panel).

    Rows of a day that come after the watermark has passed it are late and left out by the engine. A contract is one state.
    """
    rows = panel.groupBy("contract")
    return rows.transformWithStateInPandas(HoldByDay(months, exit_day), "contract string, dt date, expiry string, expiry_month int, oi double", "Append", "EventTime")
