"""a name's readings share what they have in common and equal readings of their bars alone."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import levels
from barloom.operators import zone_study as zs


def bars(seed, n=420):
    draw = np.random.default_rng(seed)
    close = draw.uniform(900, 2100, n) if seed % 2 else 100 * np.exp(draw.normal(0, 0.03, n).cumsum())
    if seed % 3 == 0:
        close = np.round(close, -1)  # plateaus and ties
    high, low = close * (1 + draw.uniform(0, 0.01, n) * (seed % 4)), close * (1 - draw.uniform(0, 0.01, n) * (seed % 4))
    if seed == 8:
        high[[50, 310]], low[311] = np.nan, np.nan
    return pd.DataFrame({"ticker": seed, "session": [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)], "high": high, "low": low, "close": close})


@pytest.mark.parametrize("seed", range(9))
def test_readings_equal_those_of_their_bars_alone(seed):
    g = bars(seed)
    high, low, close = (g[c].to_numpy(float) for c in ("high", "low", "close"))
    ends, found = list(range(7, 420, 23)), 0
    readings = levels.Readings(high, low, close)
    for n in (5, 30, 60, 250):
        readings.prepare(n, ends)
        for end in ends:
            for begin in {0, max(0, end - n)}:
                alone = [x for x, _ in levels.level_rows(g[begin:end].reset_index(drop=True)) if 0 <= close[end - 1] / x - 1 <= 0.16]
                assert readings.under(begin, end, 0.16) == alone
                found += len(alone)
    assert found


def test_peaks_of_a_name_are_ordered_once(monkeypatch):
    """Before, each of a name's 24 readings ordered its highs and lows anew."""

    class Frame:
        groupBy = select = where = lambda self, *_: self

        def applyInPandas(self, run, _):
            return run

    run, calls, real = zs.scored(Frame()), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert len(run(bars(1))) > 0
    assert len(calls) <= 3  # the name's highs, its lows, and its rows by session
