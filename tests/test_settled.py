"""Settled days: the stream with late, repeated and resolved rows against the batch version."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.streaming import incremental, settled

D = dt.date
SHAPE = "time timestamp, day date, filing string, kind string"


def at(day, hour=12):
    return dt.datetime(2024, 3, day, hour)


BATCHES = [
    [(at(4), D(2024, 3, 4), "a", "listed"), (at(4), D(2024, 3, 4), "b", "listed"), (at(4), D(2024, 3, 4), "a", "listed"), (at(4), D(2024, 3, 4), "e", "resolved")],
    [(at(5), D(2024, 3, 4), "a", "resolved"), (at(5), D(2024, 3, 5), "c", "listed"), (at(5), D(2024, 3, 4), "e", "listed")],
    [(at(6), D(2024, 3, 5), "c", "resolved"), (at(6), D(2024, 3, 6), "d", "listed"), (at(6), D(2024, 3, 5), "c", "resolved")],
    [(at(9), D(2024, 3, 9), "f", "listed")],
    [(at(10), D(2024, 3, 9), "f", "resolved"), (at(10), D(2024, 3, 6), "d", "resolved")],
    [(at(11), D(2024, 3, 4), "b", "resolved")],
]


def as_batch(spark, n, now):
    frame = spark.createDataFrame([r for b in BATCHES[:n] for r in b], SHAPE)
    listed, done = frame.where("kind = 'listed'"), frame.where("kind = 'resolved'").select("filing", F.to_date("time").alias("at"))
    return listed, done, {r.day: (r.listed, r.pending, r.status) for r in settled.day_states(listed, done, now).collect()}


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_batch(rocks, tmp_path):
    """After each batch the days that the stream has told are those of the batch version at that time."""
    spark, days = rocks, {}

    def keep(batch, _):
        days.update({r.day: (r.listed, r.pending, r.status) for r in batch.collect()})

    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = settled.stream_days(incremental.files(spark, f"{tmp_path}/in", spark.createDataFrame([], SHAPE).schema))
        incremental.drain(stream, keep, f"{tmp_path}/check", "update").awaitTermination()
        assert days == as_batch(spark, i + 1, rows[0][0].date())[2], i
    assert days[D(2024, 3, 4)] == (3, 0, "settled") and days[D(2024, 3, 6)] == (1, 0, "settled")


def test_mark_does_not_pass_an_open_day(spark):
    marks = lambda n, now: {r.day.day: r.below_mark for r in settled.with_mark(settled.day_states(*as_batch(spark, n, now)[:2], now)).collect()}
    assert marks(3, D(2024, 3, 6)) == {4: False, 5: False, 6: False}  # b is pending
    assert marks(4, D(2024, 3, 9)) == {4: True, 5: True, 6: False, 9: False}  # the fourth is given up, the sixth is not
    assert marks(6, D(2024, 3, 11)) == {4: True, 5: True, 6: True, 9: True}


def test_given_up_filings_are_still_retried(spark):
    listed, done, _ = as_batch(spark, 4, D(2024, 3, 9))
    names = lambda **k: sorted(r.filing for r in settled.to_retry(listed, done, D(2024, 3, 9), **k).collect())
    assert names() == ["b", "d", "f"] and names(ceiling=4) == ["d", "f"]


def test_backfill_takes_today_first_and_resumes():
    """Today, then the newest gaps while time is left; what failed or was not reached is found again by the next run."""
    clock, stored, order = [0.0], {"2024-03-01", "2024-03-04"}, []
    wanted = [f"2024-03-{d:02d}" for d in (1, 4, 5, 6, 7, 8)]

    def compute(day):
        order.append(day)
        clock[0] += 10
        if day == "2024-03-06" and order.count(day) == 1:
            raise RuntimeError("no data")
        stored.add(day)
        return 1

    run = lambda: incremental.backfill("2024-03-08", lambda: [d for d in wanted if d not in stored], compute, budget=15, clock=lambda: clock[0])
    first = run()
    assert order == ["2024-03-08", "2024-03-07", "2024-03-06"] and first == {"filled": ["2024-03-07"], "failed": ["2024-03-06"], "left": ["2024-03-05"]}
    assert run() == {"filled": ["2024-03-06", "2024-03-05"], "failed": [], "left": []}
    assert order[3] == "2024-03-08" and run() == {"filled": [], "failed": [], "left": []}


def test_upcoming_reports(spark):
    """The newest snapshot counts alone, and not if it is old; news after the close belongs to the next session."""
    from barloom.operators import events

    cal = spark.createDataFrame([(D(2024, 3, d), i) for i, d in enumerate((1, 4, 5, 6, 7, 8, 11))], "session date, session_idx int")
    rows = [(D(2024, 3, 2), "a", D(2024, 3, 5), "bmo"), (D(2024, 3, 3), "a", D(2024, 3, 6), "bmo"), (D(2024, 3, 3), "b", D(2024, 3, 6), "amc"), (D(2024, 3, 3), "c", D(2024, 3, 9), "bmo"), (D(2024, 3, 3), "d", D(2024, 3, 1), "bmo"), (D(2024, 3, 3), "e", D(2024, 3, 20), "bmo"), (D(2024, 3, 9), "f", D(2024, 3, 6), "bmo")]
    snaps = spark.createDataFrame(rows, "taken date, ticker string, day date, moment string")
    got = lambda asof, **k: {r.ticker: (r.session.day, r.ahead) for r in events.upcoming(snaps, cal, asof, **k).collect()}
    assert got("2024-03-04") == {"a": (6, 2), "b": (7, 3), "c": (11, 5)}
    assert got("2024-03-04", within=2) == {"a": (6, 2)}
    assert got("2024-03-04", oldest=0) == {} and got("2024-02-01") == {}


def test_step_declarations():
    clock = [0.0]

    def slow(_):
        clock[0] += 9
        return 3

    steps = [incremental.Step("a", slow, timeout=5), incremental.Step("b", slow, ["a"], timeout=50), incremental.Step("c", slow, when=lambda mark, session: session.endswith("-08"))]
    rows = incremental.run_steps(steps, {}, "2024-03-07", clock=lambda: clock[0])
    assert [(r["step"], r["status"], r["seconds"], r["late"]) for r in rows] == [("a", "ok", 9, True), ("b", "ok", 9, False), ("c", "not due", None, False)]
    for bad in ([steps[1]], [steps[0], steps[0]], [incremental.Step("x", slow, timeout=0)]):
        with pytest.raises(ValueError):
            incremental.declared(bad)
