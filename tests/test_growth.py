"""What a task holds must not grow with the tables (F10, F15 to F20, F25), and slow steps are done once (F12, F14)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.sources import roles

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_more_lines_more_parts(spark, monkeypatch):
    """Before, all lines went to as many partitions as Spark likes, whatever their number."""
    want = sorted(map(tuple, roles.bars(spark, SF).collect()))
    monkeypatch.setattr(roles, "ROWS_A_PART", 300)
    b = roles.bars(spark, SF)
    assert b.rdd.getNumPartitions() == roles.parts(spark, SF) == -(-roles.table(spark, SF, "lineitem").count() // 300)
    assert sorted(map(tuple, b.collect())) == want


def paths(spark, n=40):
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        c = [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 1 + i % 24)))]
        bars = [(x * 1.02, None if i % 7 == 0 and k == 1 else x * 0.98, None if i % 5 == 0 and k == 2 else x) for k, x in enumerate(c)]
        rows.append((i, dt.date(2020, 1, 1), None if i == 9 else 0.0 if i == 10 else 100.0, None if i == 11 else 3.0, bars if i != 12 else []))
    return spark.createDataFrame(rows, "ticker int, session date, entry double, atr double, path array<struct<h:double,l:double,c:double>>")


@pytest.mark.parametrize("rule", sorted(bt.RULES))
def test_exits_in_batches(spark, rule):
    """Missing prices, entries and ranges, zero entries and empty paths, in batches of few rows: the folds' results."""
    kind, k, n = bt.RULES[rule]
    fold = {"hold": lambda: bt.hold(n), "stop": lambda: bt.stop(*k, n), "bracket": lambda: bt.bracket(*k, n), "trail": lambda: bt.trail(*k, n)}[kind]()
    p = paths(spark)
    sound = p.where("size(path) > 0 and entry > 0 and forall(path, x -> x.c is not null)")
    want = {r[0]: (pytest.approx(r[1]), r[2]) for r in sound.select("ticker", fold["price"] / F.col("entry") - 1, fold["held"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.ticker: (r.ret, r.held) for r in bt.exits(p, [rule]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and {t: v for t, v in got.items() if t in want} == want
    assert not {9, 10, 12} & set(got)


def test_paths_do_not_become_rows(spark):
    """Before, each path's 20 bars were rows that two hash tables over all paths of a task brought together again."""
    text = plan(bt.exits(bt.with_paths(roles.bars(spark, SF)), ["stop2_hold20", "trail_2"]))
    assert "Generate" not in text and text.count("Aggregate") == 1  # that of the bars


def test_values_are_dealt_near_quantiles_only(spark):
    """Before, all values were counted one by one, and all counts went through an exchange."""
    df = spark.range(5000).selectExpr("id % 2 as g", "sqrt(id) as v")
    q = bt.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5})
    text = plan(q).splitlines()
    counted = next(i for i, x in enumerate(text) if "Aggregate [" in x and "__v" in x.split("]")[0])
    assert counted < next(i for i, x in enumerate(text) if "LeftSemi" in x)
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.25)).alias("a"), F.percentile("v", F.lit(0.5)).alias("b")).collect()}
    assert {r.g: (pytest.approx(r.a), pytest.approx(r.b)) for r in q.collect()} == want


def test_evidence_ranks_a_date_once(spark):
    """Before, each reading of the result ran the scores' windows and three exchanges of all rows and horizons anew."""
    from barloom.operators import modules as mo

    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(day), m, float((t * 7 + day) % 9), float(t % 5), None if t < 20 else float(-t)) for day in range(11) for t in range(30) for m in ("a", "b")]
    long = spark.createDataFrame(rows, "ticker int, session date, metric string, value double, x double, y double")
    found = mo.evidence(long, {"x": 5, "y": 20}, 20)
    assert "Window" not in plan(found) and "LocalRelation" not in plan(found)
    assert {(r.metric, r.horizon): (r.n_dates, r.names, r.spread is None) for r in found.collect()} == {(m, h): (11, n, n < 15) for m in "ab" for h, n in ((5, 30), (20, 10))}


def test_long_frames_are_blocks(spark):
    """Before, frames of up to 250 bars took as many steps a row."""
    from barloom.plans import catalog  # noqa: F401, I001
    from barloom.plans import module_plans as mp

    text = plan(mp.scores(spark, SF))
    assert "-249" not in text and "-199" not in text and "-9" in text


@pytest.mark.parametrize("name", ["E92_combo_score", "E91_correlation_dedup", "E90_admission"])
def test_cross_sections_are_dealt_by_rows(spark, monkeypatch, name):
    """Before, the ranks of all dates were in as many partitions as Spark likes, whatever the number of rows."""
    from barloom.plans import catalog

    seen = []
    made = type(spark.range(0))
    monkeypatch.setattr(roles, "ROWS_A_PART", 300)
    monkeypatch.setattr(made, "repartition", lambda self, n, *by, f=made.repartition: seen.append((n, by)) or f(self, n, *by))
    got = catalog.QUERIES[name](spark, SF)
    n = roles.parts(spark, SF)
    assert (n, ("ticker",)) in seen and any(k == n and by in (("session",), ("metric", "month")) for k, by in seen)
    assert got.count() > 0


def test_only_what_is_asked_is_read(spark, monkeypatch):
    """Before, peaks and runs also took the level, the volumes and all signs of a turn, most of a name's time."""
    import pandas as pd

    from barloom.operators import bounce as bo

    g = roles.walk_bars(spark, "/root/testdata/sf0.01").where("ticker < 6").toPandas()
    names = [x.sort_values("session").reset_index(drop=True) for _, x in g.groupby("ticker")]
    whole = [bo.read_name(x) for x in names]
    assert any("bounce" in x for x in whole)

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(bo, "level_and_volume", never)
    turn = [bo.read_name(x, "turn") for x in names]
    monkeypatch.setattr(bo, "turn_signs", never)
    for only, found in (("peak", [bo.read_name(x, "peak") for x in names]), ("run", [bo.read_name(x, "run") for x in names]), ("turn", turn)):
        for w, f in zip(whole, found, strict=True):
            assert {"peak": "peak", "run": "run_x", "turn": "bounce"}[only] in f or "bounce" not in w
            assert all(v == w[k] or (pd.isna(v) and pd.isna(w[k])) for k, v in f.items() if k != "tops")


def test_beta_of_blocks(spark):
    """Before, a frame of 120 rows took as many steps a row; a flat market has no spread, whatever rounding leaves."""
    from barloom.operators import windows as w

    rng, rows = np.random.default_rng(2), []
    for t in range(3):
        rows += [(t, dt.date(2020, 1, 1) + dt.timedelta(i), None if (t, i) == (1, 30) else float(x)) for i, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.1, 70))))]
    df = spark.createDataFrame(rows, "ticker int, session date, close double")
    found = w.with_market_beta(df, 12, 4)
    assert "-11" not in plan(found)
    p = df.toPandas()
    p["r"] = p.groupby("ticker")["close"].transform(lambda c: c / c.shift() - 1)
    p["m"] = p.groupby("session")["r"].transform("mean")
    want = {}
    for t, g in p.groupby("ticker"):
        r, m = g["r"].tolist(), g["m"].tolist()
        for i, day in enumerate(g["session"]):
            a, b = np.array(r[max(i - 11, 0) : i + 1]), np.array(m[max(i - 11, 0) : i + 1])
            both, there = ~np.isnan(a) & ~np.isnan(b), ~np.isnan(b)
            want[t, day] = pytest.approx(np.clip(np.cov(a[both], b[both])[0, 1] / b[there].var(ddof=1), -3, 5)) if both.sum() >= 4 else None
    assert {(x.ticker, x.session): x.beta for x in found.collect()} == want
    flat = spark.createDataFrame([(t, dt.date(2020, 1, 1) + dt.timedelta(i), 1.1**i) for t in range(2) for i in range(40)], "ticker int, session date, close double").withColumn("close", F.lit(100.0))
    assert w.with_market_beta(flat, 12, 4).where("beta is not null").count() == 0


def test_anchors_across_batches(spark):
    """Before, each company was a call of its own. Batches end inside companies here."""
    from barloom.operators import accounting as ac

    days = {1: [0, 10, 45, 46, 91, 92, 200], 2: [0], 3: [5, 50, 51, 60, 97]}
    want = {1: [0, 0, 0, 46, 46, 92, 200], 2: [0], 3: [5, 5, 51, 51, 97]}
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = ac.anchored(spark.createDataFrame([(k, day(x)) for k, v in days.items() for x in v], "cik long, filed date"), "cik", "filed", 45)
        assert "FlatMapGroups" not in plan(found)
        got = {(x.cik, x.filed): x.anchor for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, day(x)): day(y) for k in days for x, y in zip(days[k], want[k], strict=True)}
