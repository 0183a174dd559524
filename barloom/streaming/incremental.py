"""Incremental runs: file streams drained once by a watermark of what is stored, late rows merged, steps in order."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barloom.operators.upsert import upsert


def files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def drain(stream: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what has arrived since the last run, then ends."""
    return stream.writeStream.outputMode(mode).foreachBatch(to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_sink(path: str, keys: list[str], by: list[str], max_day: str | None = None, day: str = "session") -> Callable[[DataFrame, int], None]:
    """Merges each batch into a store; rows of days that are not settled yet stay out."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch if max_day is None else batch.where(F.col(day) <= F.lit(max_day).cast("date"))
        upsert(batch.sparkSession, path, rows, keys, by)

    return write


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Bursts of events of one key with no longer pause than gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *by, "n")


@dataclass
class Step:
    """A step of the daily run: due when its watermark lies before the session, blocked while one that it needs failed.

    timeout is what the step should take at most, in seconds: a step that takes longer is told as late, not stopped.
    when, if given, decides instead of the cadence: when(watermark, session)."""

    name: str
    run: Callable[[str], int]
    needs: list[str] = field(default_factory=list)
    weekly: bool = False
    timeout: float | None = None
    when: Callable[[str | None, str], bool] | None = None


def declared(steps: list[Step]) -> list[Step]:
    """The steps, if their names differ and each needs only steps before it: an order that can be run."""
    seen: set[str] = set()
    for s in steps:
        if s.name in seen or not set(s.needs) <= seen or (s.timeout is not None and s.timeout <= 0):
            raise ValueError(f"step {s.name!r} is named twice, needs what does not come before it, or has no time")
        seen.add(s.name)
    return steps


def due(step: Step, watermark: str | None, session: str) -> bool:
    import datetime as dt

    if step.when is not None:
        return step.when(watermark, session)
    if watermark is None:
        return True
    if step.weekly:
        week = lambda s: dt.date.fromisoformat(s).isocalendar()[:2]
        return week(watermark) < week(session)
    return watermark < session


def run_steps(steps: list[Step], watermarks: dict[str, str], session: str, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Runs what is due in the order given; returns a ledger row a step and moves the watermarks of those that ended well."""
    ledger, failed = [], set()
    for s in declared(steps):
        row = {"step": s.name, "session": session, "status": "not due", "rows": None, "error": None, "seconds": None, "late": False}
        began = clock()
        if failed & set(s.needs):
            row["status"] = "blocked"
            failed.add(s.name)
        elif due(s, watermarks.get(s.name), session):
            try:
                row |= {"status": "ok", "rows": s.run(session)}
                watermarks[s.name] = session
            except Exception as e:  # a failed step must not end the run
                row |= {"status": "failed", "error": str(e)[:500]}
                failed.add(s.name)
            took = clock() - began
            row |= {"seconds": took, "late": s.timeout is not None and took > s.timeout}
        ledger.append(row)
    return ledger


def backfill(today: str, missing: Callable[[], list[str]], compute: Callable[[str], int], budget: float, most: int | None = None, clock: Callable[[], float] = time.monotonic) -> dict:
    """Computes today, then missing sessions from the newest back until budget seconds are spent on them.

    missing is asked after today is done and reads the store, so that a run resumes where the last one ended, whatever
    ended it. A session is not interrupted once begun; one that fails stays missing. Returns what was filled, failed and
    left."""
    compute(today)
    gaps = sorted((d for d in missing() if d != today), reverse=True)[:most]
    began, out = clock(), {"filled": [], "failed": [], "left": []}
    for i, day in enumerate(gaps):
        if clock() - began > budget:
            out["left"] = gaps[i:]
            break
        try:
            compute(day)
            out["filled"].append(day)
        except Exception:  # one session's failure must not end the run
            out["failed"].append(day)
    return out
