"""Two-level trades worked by hand: slots of the entry day, then days."""

import datetime as dt

import pytest

from barloom.operators import intraday as it

BARS = "array<struct<slot: int, open: double, high: double, low: double, close: double>>"
SHAPE = f"ticker long, day date, slot int, price double, inside boolean, slots {BARS}, after array<struct<open: double, high: double, low: double, close: double>>"
DAY = dt.date(2024, 5, 6)
QUIET = (100.0, 101.0, 99.0, 100.0)


def s(k, *bar):
    return (k, *bar)


CASES = {
    "target on the second day after": ((0, 100.0, False, [s(0, *QUIET)], [QUIET, (100.0, 106.0, 99.0, 104.0)]), (0.05, 3, "target")),
    "stop inside the entry day": ((0, 100.0, False, [s(0, *QUIET), s(1, 100.0, 100.0, 94.0, 96.0)], [QUIET]), (-0.05, 2, "stop")),
    "gap down fills at the open": ((0, 100.0, False, [s(0, *QUIET)], [(93.0, 99.0, 92.0, 98.0)]), (-0.07, 2, "stop")),
    "gap up fills at the open": ((0, 100.0, False, [s(0, *QUIET)], [(107.0, 108.0, 106.0, 107.0)]), (0.07, 2, "target")),
    "gap between slots": ((0, 100.0, False, [s(0, *QUIET), s(5, 92.0, 99.0, 91.0, 98.0)], []), (-0.08, 2, "stop")),
    "both touched is the stop": ((0, 100.0, False, [s(0, 100.0, 106.0, 94.0, 100.0)], []), (-0.05, 1, "stop")),
    "time exit at the last close": ((0, 100.0, False, [s(0, *QUIET)], [QUIET, (100.0, 102.0, 99.0, 101.0)]), (0.01, 3, "time")),
    "slots before the entry do not count": ((3, 100.0, False, [s(0, 100.0, 120.0, 80.0, 100.0), s(3, *QUIET)], [QUIET]), (0.0, 2, "time")),
    "filled inside: the slot's high does not count": ((0, 100.0, True, [s(0, 103.0, 106.0, 99.0, 102.0)], [QUIET]), (0.0, 2, "time")),
    "filled inside: its low does": ((0, 100.0, True, [s(0, 103.0, 106.0, 94.0, 95.0)], [QUIET]), (-0.05, 1, "stop")),
    "no gap at the entry bar's own open": ((0, 100.0, True, [s(0, 110.0, 111.0, 99.0, 100.0)], [(100.0, 105.0, 99.0, 104.0)]), (0.05, 2, "target")),
    "days beyond the holding time do not count": ((0, 100.0, False, [s(0, *QUIET)], [QUIET] * 4 + [(100.0, 120.0, 99.0, 110.0)]), (0.0, 5, "time")),
}


def test_ends(spark):
    rows = [(i, DAY, *c[0]) for i, c in enumerate(CASES.values())]
    got = {r.ticker: (r.ret, r.bars, r.kind) for r in it.settled(spark.createDataFrame(rows, SHAPE), 0.05, 0.05, 5).collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == (pytest.approx(want[0], abs=1e-12), *want[1:]), name


def trades(spark, rows):
    at = lambda d, h, m: dt.datetime(2024, 5, d, h, m)
    return spark.createDataFrame([(t, at(d, h, m), p) for t, d, h, m, p in rows], "user long, ts timestamp, price double")


def test_slots_and_days(spark):
    rows = [(1, 6, 10, 0, 100.0), (1, 6, 10, 29, 103.0), (1, 6, 10, 15, 98.0), (1, 6, 15, 0, 101.0), (1, 8, 9, 0, 90.0), (1, 6, 11, 0, None), (1, 6, 11, 1, 0.0)]
    b = it.slots(trades(spark, rows), "user", "ts", "price")
    assert sorted((r.day.day, r.slot, r.open, r.high, r.low, r.close) for r in b.collect()) == [(6, 20, 100.0, 103.0, 98.0, 103.0), (6, 30, 101.0, 101.0, 101.0, 101.0), (8, 18, 90.0, 90.0, 90.0, 90.0)]
    assert [(r.day.day, r.n, r.open, r.high, r.low, r.close, len(r.slots)) for r in it.days(b).orderBy("day").collect()] == [(6, 1, 100.0, 103.0, 98.0, 101.0, 2), (8, 2, 90.0, 90.0, 90.0, 90.0, 1)]


def test_limit_orders(spark):
    """A close of 100 and a limit of 90: filled at a lower open, through the limit inside a slot, or never."""
    day = lambda t, d, *prices: [(t, d, 10 + i, 0, p) for i, p in enumerate(prices)]
    rows = day(1, 6, 100.0) + day(1, 7, 95.0, 88.0, 92.0) + day(2, 6, 100.0) + day(2, 7, 95.0, 92.0) + day(2, 8, 91.0) + day(2, 9, 91.0) + day(2, 10, 50.0)
    rows += [(3, 6, 10, 0, 100.0), (3, 7, 10, 0, 95.0), (3, 7, 10, 5, 89.0), (3, 7, 11, 0, 93.0)]
    b = it.days(it.slots(trades(spark, rows), "user", "ts", "price"))
    got = {(r.ticker, r.signal.day): (r.day.day, r.price, r.ret, r.kind) for r in it.limit_orders(b, 0.1, 0.002, 3, 0.5, 0.5, 3).collect()}
    assert got[1, 6] == (7, 88.0, pytest.approx(92 / 88 - 1), "time")
    assert (2, 6) not in got  # 91 is not 90, and the fourth day is too late
    assert got[3, 6] == (7, 90.0, pytest.approx(93 / 90 - 1), "time")
    assert got[2, 7][:2] == (10, 50.0)  # an order of the next day still waits on the fourth
