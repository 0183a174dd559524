"""Zone lengths: readings see the past alone, placebos keep off real levels, outcomes by hand, shares by date."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import zone_study as zs

DAY = dt.date(2020, 1, 1)


def wave(ticker, n=400, seed=0):
    """A price that turns at two levels again and again."""
    rng = np.random.default_rng(seed + ticker)
    x = 100 + 12 * np.sin(np.arange(n) / 9 + ticker) + rng.normal(0, 0.6, n)
    return pd.DataFrame({"ticker": ticker, "session": [DAY + dt.timedelta(int(i)) for i in range(n)], "high": x + 1, "low": x - 1, "close": x})


def test_outcome():
    low, close = np.array([100.0, 104.0, 101.0, 99.0, 96.0, 118.0]), np.array([101.0, 105.0, 102.0, 100.0, 89.0, 120.0])
    assert zs.outcome(low, close, 0, 90.0, 5, 2) == (False, None, None)
    assert zs.outcome(low, close, 0, 100.0, 5, 2) == (True, False, False)  # touched on the third bar, held for two
    assert zs.outcome(low, close, 0, 100.0, 5, 4) == (True, True, True)
    assert zs.outcome(low, close, 0, 100.0, 5, 5) == (True, None, None)  # the hold is not over
    assert zs.outcome(low, close, 0, 100.0, 1, 2) == (False, None, None)


def test_placebos_keep_off_real_levels():
    real = np.array([95.0, 90.0, 86.0])
    for bar in range(200):
        for x in zs.placebos(7, bar, 100.0, real):
            assert 84.0 <= x <= 99.5 and np.abs(np.log(real / x)).min() >= 0.02
    assert len({x for b in range(50) for x in zs.placebos(7, b, 100.0, np.zeros(0))}) == 200


def test_scored_against_plain_calls(spark):
    frame = pd.concat([wave(t) for t in (1, 2)])
    got = {(r.session, r.arm, r.ticker, round(r.level, 9)): (r.reached, r.failed, r.hit) for r in zs.scored(spark.createDataFrame(frame), (120, 200), 25, 250, 30, 10).collect()}
    want = {}
    for t in (1, 2):
        g = wave(t)
        for at in range(249, 399, 25):
            full = zs.zone_levels(g[: at + 1])
            for arm, levels in (("full", full), ("200", zs.zone_levels(g[at - 199 : at + 1].reset_index(drop=True))), ("120", zs.zone_levels(g[at - 119 : at + 1].reset_index(drop=True))), ("placebo", zs.placebos(t, at, g["close"][at], full))):
                for x in levels:
                    want[g["session"][at], arm, t, round(float(x), 9)] = zs.outcome(g["low"].to_numpy(), g["close"].to_numpy(), at, x, 30, 10)
    assert got == want and {k[1] for k in want} == {"full", "200", "120", "placebo"}


def test_levels_see_only_the_past(spark):
    g = wave(3)
    cut = g["session"][324]
    later = g["session"] > cut
    moved = g.assign(**{c: g[c].where(~later, g[c] * 1.7) for c in ("high", "low", "close")})
    levels = lambda f: {(r.session, r.arm, round(r.level, 9)) for r in zs.scored(spark.createDataFrame(f), (120,), 25, 250, 30, 10).collect() if r.session <= cut}
    assert levels(g) == levels(moved) and levels(g)


def test_by_arm(spark):
    d = lambda i: DAY + dt.timedelta(i)
    rows = [(d(i), arm, 1, 1.0, True, not h, h) for i, (full, short) in enumerate([(True, False), (True, True), (False, False), (True, False)]) for arm, h in (("full", full), ("60", short))]
    rows += [(d(0), "60", 1, 2.0, False, None, None), (d(9), "60", 1, 2.0, True, False, True)]
    got = {r.arm: r for r in zs.by_arm(spark.createDataFrame(rows, zs.SCORED)).collect()}
    assert (got["full"].diff, got["full"].t, got["full"].hit, got["full"].levels) == (0.0, None, 0.75, 4)
    gaps = np.array([-1, 0, 0, -1])
    assert (got["60"].dates, got["60"].levels, got["60"].hit) == (4, 6, 0.4)
    assert got["60"].diff == pytest.approx(gaps.mean()) and got["60"].t == pytest.approx(gaps.mean() / (gaps.std(ddof=1) / 2))
