"""The module contract: declarations, one plan for all metrics, nothing read past the date, evidence of planted metrics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import modules as mo
from barloom.plans import module_plans as mp
from barloom.sources.roles import bars

SF = "/root/testdata/sf0.001"


def test_declarations():
    one = mo.Metric("x", lambda: F.lit(1.0))
    assert mo.registered() == sorted(m.name for m in mp.MODULES) and mo.get("pace") is mp.PACE
    assert mo.register(mp.PACE) is mp.PACE
    with pytest.raises(ValueError):
        mo.register(mo.Module("pace", (one,)))
    with pytest.raises(ValueError):
        mo.register(mo.Module("other", (mo.Metric("ret5", lambda: F.lit(1.0)),)))
    with pytest.raises(ValueError):
        mo.Module("twice", (one, one))
    with pytest.raises(ValueError):
        mo.Strategy("s", (("x", 2, 1.0),))
    with pytest.raises(KeyError):
        mo.get("nowhere")


def test_undeclared_metric_is_an_error(spark):
    scores = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0)], "ticker long, session date, made_up double")
    with pytest.raises(ValueError):
        mo.tidy(scores, mp.MODULES)
    with pytest.raises(ValueError):
        mo.strategy_scores(scores, mp.STRATEGIES)


def test_one_scan_serves_all_metrics(spark):
    plan = mp.scores(spark, SF).drop("fwd5", "fwd20")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") > 0 and sum(line.strip().startswith(("+- Relation", "Relation", ":- Relation", ": +- Relation")) or "Relation [" in line for line in plan.splitlines()) <= 2  # bars, calendar


def test_compute_reads_only_the_past(spark):
    b = bars(spark, SF).where("ticker < 4")
    asof = dt.date(1998, 6, 1)
    before = {tuple(r)[:2]: r.value for r in mo.compute(b, mp.PACE, asof).collect()}
    scrambled = b.withColumn("close", F.when(F.col("session") > F.lit(asof), F.col("close") * 3).otherwise(F.col("close")))
    assert before and before == {tuple(r)[:2]: r.value for r in mo.compute(scrambled, mp.PACE, asof).collect()}
    live = {r.ticker for r in mo.compute(b, mp.PACE, asof, spark.createDataFrame([(1,)], "ticker long")).collect()}
    assert live == {1}


def planted(spark):
    r, rows = random.Random(5), []
    for day in range(12):
        for t in range(40):
            v = r.random()
            rows += [(t, dt.date(2020, 1, 1) + dt.timedelta(day), m, x, v, -v) for m, x in (("good", v), ("bad", -v), ("flat", 1.0), ("noise", r.random()))]
    return spark.createDataFrame(rows, "ticker long, session date, metric string, value double, up double, down double")


def test_evidence_of_planted_metrics(spark):
    found = {(x.metric, x.horizon): x for x in mo.evidence(planted(spark), {"up": 5, "down": 1}, 20).collect()}
    assert found["good", 5].ic > 0.99 and found["good", 1].ic < -0.99 and found["bad", 5].ic < -0.99
    assert found["good", 5].spread > 0 and abs(found["good", 5].ic_random) < 0.35
    assert ("flat", 5) not in found  # a metric without spread has no correlation, and no row


def test_turnover_of_a_constant_ranking(spark):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(day), m, float(t if m == "still" else (t + 17 * day) % 40)) for day in range(5) for t in range(40) for m in ("still", "moving")]
    found = {x.metric: x.turnover for x in mo.top_turnover(spark.createDataFrame(rows, "ticker long, session date, metric string, value double")).collect()}
    assert found["still"] == 0 and found["moving"] > 0.5


def test_combo_weights_themes_by_evidence(spark):
    """Two themes with |t| of 6 and 2: a name that is best in the first and worst in the second; a theme that a name lacks
    does not vote; a name with less than half of the metrics has no score."""
    day = dt.date(2020, 1, 1)
    rows = [(t, day, m, float(v)) for m, by in {"a": [1, 2, 3, 4], "b": [4, 3, 2, 1], "c": [4, 3, 2, 1]}.items() for t, v in enumerate(by) if not (t == 0 and m != "a")]
    proof = spark.createDataFrame([("a", "one", 6.0), ("b", "two", 2.0), ("c", "two", -2.0)], "metric string, theme string, t double")
    out = {(x.ticker, x.metric): x.value for x in mo.combo(spark.createDataFrame(rows, "ticker long, session date, metric string, value double"), proof).collect()}
    assert ("0", "combo") not in out and out["0", "combo_cov"] == pytest.approx(1 / 3)
    b, c = 100 / 3, 100 - 100 / 3
    assert out["3", "combo"] == pytest.approx((6 * 100 + 2 * (b + c) / 2) / 8)
    assert out["_ALL", "combo_n"] == 3


def test_recipes():
    one = mo.recipes('[{"name": "a", "sort": [["x", "desc"]], "top": 2}]')[0]
    assert one == mo.Recipe("a", (("x", "desc"),), 2)
    for bad in ('[{"name": "a", "sort": [["x", "up"]], "top": 2}]', '[{"name": "a", "sort": [], "top": 2}]', '[{"name": "a", "sort": [["x", "asc"]], "top": 0}]', '[{"name": "a", "sort": [["x", "asc"]], "top": 1}, {"name": "a", "sort": [["x", "asc"]], "top": 1}]'):
        with pytest.raises(ValueError):
            mo.recipes(bad)
    with pytest.raises(TypeError):
        mo.recipes('[{"name": "a", "sort": [["x", "asc"]], "top": 1, "limit": 3}]')
