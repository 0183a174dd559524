"""Quantiles of many values up to each row (F11, F13)."""

import datetime as dt

import numpy as np

from barloom.operators import windows as w
from barloom.plans import catalog


def test_rolling_quantile(spark):
    draw = np.random.default_rng(3)
    made = {t: [None if draw.random() < 0.1 else float(draw.integers(0, 30)) for _ in range(120)] for t in (1, 2)} | {3: [None, None, 4.0]}
    rows = [(t, dt.date(2025, 1, 1) + dt.timedelta(days=i), x) for t, v in made.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "ticker long, session date, v double").repartition(3, "v")
    got = {(x.ticker, x.session): x.q for x in w.with_rolling_quantile(df, "v", 25, 0.9, "q").collect()}
    assert len(got) == len(rows)
    for t, v in made.items():
        for i in range(len(v)):
            held = [x for x in v[max(0, i - 24) : i + 1] if x is not None]
            q = got[t, dt.date(2025, 1, 1) + dt.timedelta(days=i)]
            assert (q is None) if not held else abs(q - np.quantile(held, 0.9)) < 1e-12


def test_no_window_counts_its_values_anew(spark):
    for name in ("F13_median_range", "F11_ma_shift"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan, name
