"""Settled days of a filing feed: a day closes when all filings listed on it are resolved, or is given up after some days;
the mark never passes an open day. Once as a batch over what is known, once as a stream with state and timers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAYS = "day date, listed long, pending long, status string"
TOLERANCE, CEILING = 3, 120


def day_states(listed: DataFrame, resolved: DataFrame, now, tolerance: int = TOLERANCE) -> DataFrame:
    """DAYS for every day up to now. listed: (day, filing); resolved: (filing, at). A day is `settled` without pending
    filings, `tolerated` with some once more than tolerance days have passed, else `open`. Repeats count once; a filing
    may be resolved before it is listed."""
    known = listed.where(F.col("day") <= F.lit(now)).select("day", "filing").distinct()
    done = resolved.where(F.col("at") <= F.lit(now)).select("filing").distinct().withColumn("done", F.lit(True))
    days = known.join(done, "filing", "left").groupBy("day").agg(F.count("*").alias("listed"), F.count_if(F.col("done").isNull()).alias("pending"))
    old = F.datediff(F.lit(now), "day") > tolerance
    return days.select("day", "listed", "pending", F.when(F.col("pending") == 0, "settled").when(old, "tolerated").otherwise("open").alias("status"))


def with_mark(days: DataFrame) -> DataFrame:
    """days with below_mark: no day up to this one is open. Days are some hundreds a year."""
    opened = F.max((F.col("status") == "open").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("below_mark", opened == 0)


def to_retry(listed: DataFrame, resolved: DataFrame, now, tolerance: int = TOLERANCE, ceiling: int = CEILING) -> DataFrame:
    """(day, filing) still to be fetched: pending filings of all days that a run looks back to, the tolerated ones too."""
    done = resolved.where(F.col("at") <= F.lit(now)).select("filing").distinct()
    recent = (F.col("day") <= F.lit(now)) & (F.datediff(F.lit(now), "day") <= ceiling)
    return listed.where(recent).select("day", "filing").distinct().join(done, "filing", "left_anti").select("day", "filing")


class DayKeeper(StatefulProcessor):
    """State of one day: filings pending, filings resolved before they were listed, a count of all listed; a timer gives
    the day up after tolerance days of event time. A settled day keeps its count alone."""

    def __init__(self, tolerance: int = TOLERANCE):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filings = handle.getMapState("filings", "filing string", "state string")
        self.summary = handle.getValueState("summary", "listed long, pending long, status string")

    def row(self, key: tuple, listed: int, pending: int, status: str) -> pd.DataFrame:
        self.summary.update((listed, pending, status))
        return pd.DataFrame({"day": [key[0]], "listed": [listed], "pending": [pending], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.summary.exists()
        listed, pending, status = (0, 0, "open") if fresh else self.summary.get()
        if fresh:
            end = dt.datetime.combine(key[0], dt.time(), dt.timezone.utc) + dt.timedelta(days=self.tolerance + 1)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        for frame in rows:
            for filing, kind in zip(frame["filing"], frame["kind"], strict=True):
                name = (filing,)
                held = self.filings.getValue(name)[0] if self.filings.containsKey(name) else None
                if kind == "listed" and held in (None, "early"):
                    listed += 1
                    pending += held is None
                    self.filings.updateValue(name, ("pending" if held is None else "done",))
                elif kind == "resolved" and held in (None, "pending"):
                    pending -= held == "pending"
                    self.filings.updateValue(name, ("done" if held else "early",))
        yield self.row(key, listed, pending, "settled" if not pending else "tolerated" if status == "tolerated" else "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        listed, pending, status = self.summary.get()
        if status == "open":
            yield self.row(key, listed, pending, "tolerated")

    def close(self) -> None:
        pass


def stream_days(events: DataFrame, tolerance: int = TOLERANCE, late: str = "0 seconds") -> DataFrame:
    """DAYS as they change. events: (time timestamp, day date, filing string, kind 'listed' or 'resolved'), time being when
    the row came in. Needs the RocksDB state store."""
    seen = events.withWatermark("time", late)
    return seen.groupBy("day").transformWithStateInPandas(statefulProcessor=DayKeeper(tolerance), outputStructType=DAYS, outputMode="Update", timeMode="EventTime")
