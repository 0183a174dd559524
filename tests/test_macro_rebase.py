"""Macro files with vintages, what was known on a day, re-basing that runs twice, derived concepts by hand."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import accounting as ac
from barloom.operators import rebase
from barloom.operators import upsert as up
from barloom.sources import macro

D = dt.date


def test_observations(spark, tmp_path):
    obs = [("2024-01-01", "2.5", "2024-02-10", "2024-03-09"), ("2024-01-01", "2.7", "2024-03-10", "9999-12-31"), ("2024-02-01", ".", "2024-03-10", "9999-12-31")]
    page = {"observations": [dict(zip(("date", "value", "realtime_start", "realtime_end"), x, strict=True)) for x in obs] + [{"date": "2024-03-01", "value": "3"}]}
    (tmp_path / "CPI.json").write_text(json.dumps(page))
    (tmp_path / "RATE-2.json").write_text(json.dumps({"observations": []}))
    got = sorted(map(tuple, macro.observations(spark, str(tmp_path)).collect()))
    assert got == [("CPI", D(2024, 1, 1), 2.5, D(2024, 2, 10), D(2024, 3, 9)), ("CPI", D(2024, 1, 1), 2.7, D(2024, 3, 10), D(9999, 12, 31)), ("CPI", D(2024, 3, 1), 3.0, D(2024, 3, 1), D(9999, 12, 31))]


def test_release_dates(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"release_dates": [{"release_id": 10, "date": "2024-02-13"}, {"release_id": 10, "date": "2024-02-13"}, {"release_id": 99, "date": "2024-02-14"}]}))
    releases = macro.release_dates(spark, str(tmp_path), {10: "prices"})
    assert [tuple(r) for r in releases.collect()] == [(D(2024, 2, 13), "prices")]
    days = spark.createDataFrame([(D(2024, 2, d), d) for d in (9, 12, 13, 14)], "session date, session_idx int")
    assert sorted((r.session.day, r.ahead) for r in macro.sessions_to_release(days, releases).collect()) == [(9, 2), (12, 1), (13, 0)]
    holiday = spark.createDataFrame([(D(2024, 2, 15), "prices")], "date date, release string")
    assert sorted((r.session.day, r.ahead) for r in macro.sessions_to_release(days, holiday).collect()) == [(9, 4), (12, 3), (13, 2), (14, 1)]


def test_index_files(spark, tmp_path):
    (tmp_path / "epu.csv").write_text("day,month,year,daily_policy_index\n1,2,2024,101.5\n30,2,2024,9\n2,2,2024,\nSource: notes,,,\n")
    assert [tuple(r) for r in macro.policy_index(spark, str(tmp_path / "epu.csv")).collect()] == [(D(2024, 2, 1), 101.5)]
    (tmp_path / "gpr.csv").write_text("DATE_x,GPR,gprd\n2024-02-01,5,120\n2/3/2024,5,121\nlast,5,7\n")
    assert [tuple(r) for r in macro.risk_index(spark, str(tmp_path / "gpr.csv")).collect()] == [(D(2024, 2, 1), 120.0), (D(2024, 2, 3), 121.0)]
    (tmp_path / "none.csv").write_text("date,x\n2024-02-01,5\n")
    with pytest.raises(ValueError):
        macro.risk_index(spark, str(tmp_path / "none.csv"))


def test_known_on_a_day(spark):
    """First prints, revisions, an old month revised after a new one came, a number withdrawn, days before all."""
    end = D(9999, 12, 31)
    v = [("a", D(2024, 1, 1), 1.0, D(2024, 2, 10), D(2024, 3, 9)), ("a", D(2024, 1, 1), 1.5, D(2024, 3, 10), D(2024, 5, 31)), ("a", D(2024, 1, 1), 1.6, D(2024, 6, 1), end), ("a", D(2024, 2, 1), 2.0, D(2024, 3, 20), end), ("b", D(2024, 1, 1), 9.0, D(2024, 2, 1), D(2024, 2, 20))]
    frame = spark.createDataFrame(v, "series string, obs_date date, value double, realtime_start date, realtime_end date")
    days = [D(2024, 2, 9), D(2024, 2, 10), D(2024, 3, 15), D(2024, 3, 20), D(2024, 6, 2)]
    got = {(r.series, r.session): (r.obs_date, r.value) for r in macro.known_on(frame, spark.createDataFrame([(d,) for d in days * 2], "session date")).collect()}
    assert ("a", days[0]) not in got and got["a", days[1]] == (D(2024, 1, 1), 1.0) and got["a", days[2]] == (D(2024, 1, 1), 1.5)
    assert got["a", days[3]] == got["a", days[4]] == (D(2024, 2, 1), 2.0)
    assert got["b", days[1]] == (D(2024, 1, 1), 9.0) and got["b", days[2]] == (D(2024, 1, 1), None)


def history(seed=1, n=120):
    r, rows, price = random.Random(seed), [], {}
    for t in (1, 2, 3, 4):
        price[t] = 50.0
        for i in range(n):
            price[t] *= math.exp(r.gauss(0, 0.01))
            # 1: two spin-offs; 2: adjusted already; 3: a step of another size; 4: a step soon after the start.
            k = {1: 2.0 if i < 60 else 1.25 if i < 90 else 1.0, 2: 1.0, 3: 2.0 if i < 60 else 1.0, 4: 1.5 if i < 5 else 1.0}[t]
            rows.append((t, D(2024, 1, 1) + dt.timedelta(i), *[price[t] * k] * 4, 100.0))
    return rows


SHAPE = "ticker long, session date, open double, high double, low double, close double, volume double"


def test_rebasing_twice_changes_nothing(spark, tmp_path):
    day = lambda i: D(2024, 1, 1) + dt.timedelta(i)
    bars = spark.createDataFrame(history(), SHAPE).withColumn("month", F.date_format("session", "yyyy-MM"))
    path = str(tmp_path / "bars")
    up.write_partitions(bars, path, ["month"])
    declared = spark.createDataFrame([(1, day(60), 0.625), (1, day(90), 0.8), (2, day(60), 0.5), (3, day(60), 0.9), (4, day(5), 2 / 3), (9, day(60), 0.5)], "ticker long, ex date, factor double")
    act = lambda f: {(r.ticker, r.ex): r.action for r in f.collect()}
    first = rebase.rebase_store(spark, path, declared)
    assert act(first) == {(1, day(60)): "adjust", (1, day(90)): "adjust", (2, day(60)): "held", (3, day(60)): "refuse", (4, day(5)): "adjust", (9, day(60)): "skip"}
    after = {(r.ticker, r.session): r.close for r in spark.read.parquet(path).collect()}
    plain = {(t, d): c / ({1: 2.0 if (d - day(0)).days < 60 else 1.25 if (d - day(0)).days < 90 else 1.0, 4: 1.5 if (d - day(0)).days < 5 else 1.0}.get(t, 1.0)) for t, d, _, _, _, c, _ in history()}
    assert all(after[k] == pytest.approx(plain[k]) for k in plain) and len(after) == len(plain)
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    assert set(act(rebase.rebase_store(spark, path, declared)).values()) == {"held", "refuse", "skip"}
    assert files == {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    bars = spark.createDataFrame(history(), SHAPE).withColumn("month", F.date_format("session", "yyyy-MM"))
    path = str(tmp_path / "bars")
    up.write_partitions(bars, path, ["month"])
    times = lambda m: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "bars" / f"month={m}").glob("*.parquet")}
    before = times("2024-04")
    rebase.rebase_store(spark, path, spark.createDataFrame([(4, D(2024, 1, 6), 2 / 3)], "ticker long, ex date, factor double"))
    assert times("2024-04") == before


def test_cut_moves_old_bars_once(spark):
    bars, cuts = spark.createDataFrame([("A", D(2024, 1, d), 1.0) for d in (1, 2, 3)] + [("B", D(2024, 1, 1), 1.0)], "ticker string, session date, close double"), spark.createDataFrame([("A", D(2024, 1, 3), "A_OLD")], "ticker string, keep_from date, archive string")
    once = rebase.cut(bars, cuts)
    assert sorted((r.ticker, r.session.day) for r in once.collect()) == [("A", 3), ("A_OLD", 1), ("A_OLD", 2), ("B", 1)]
    assert sorted(map(tuple, rebase.cut(once, cuts).collect())) == sorted(map(tuple, once.collect()))


def concepts(spark, **lines):
    frame = spark.createDataFrame([tuple(lines.values())], ", ".join(f"{k} double" for k in lines))
    return frame.select(*[v.alias(k) for k, v in ac.derived(frame.columns).items()]).first()


def test_derived_concepts(spark):
    x = concepts(spark, revenue_ttm=None, revenue=100.0, cogs=60.0, capex_ttm=-7.0, cfo=20.0, opinc=15.0, deprec=2.0, cash=5.0, debt_lt=30.0, debt_st=None, equity=50.0, tax=9.0, pretax=10.0)
    assert (x.revenue, x.gross_profit, x.capex, x.fcf, x.dna, x.ebitda) == (100.0, 40.0, 7.0, 13.0, 2.0, 17.0)
    assert (x.debt, x.net_debt, x.invested_capital, x.tax_rate, x.nopat) == (30.0, 25.0, 75.0, 0.5, 7.5)
    assert x.shares is None and x.assets is None


def test_bank_revenue_and_revenue_that_cannot_be(spark):
    assert concepts(spark, revenue=50.0, nii_ttm=70.0, nonint_income_ttm=30.0).revenue == 100.0
    assert concepts(spark, revenue=95.0, nii_ttm=70.0, nonint_income_ttm=30.0).revenue == 95.0
    assert concepts(spark, revenue=5.0, net_income=10.0).revenue is None
    assert concepts(spark, revenue=5.0, net_income=10.0, opinc=4.0).revenue == 5.0
    assert concepts(spark, revenue=5.0, net_income=10.0, opinc=6.0, pretax=1.0).revenue is None
    assert concepts(spark, revenue=5.0, net_income=10.0, pretax=1.0).revenue == 5.0
    assert concepts(spark, pretax=0.0, tax=1.0).tax_rate == 0.21
