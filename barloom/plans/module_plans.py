"""Score modules over bars, their leaderboard, strategies and the combined score."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.ranks import ratio
from barloom.operators import modules as mo
from barloom.operators import windows as w
from barloom.operators.modules import Metric, Module, Strategy
from barloom.operators.staged import stored
from barloom.plans.catalog import query, r
from barloom.plans.cross_plans import avg_rank
from barloom.sources.roles import BARS, CALENDAR, bars, calendar

T = "PARTITION BY ticker ORDER BY session"
C = F.col


def back(n: int, value: str = "close"):
    return F.lag(value, n).over(w.order())


BLOCK = 10


def blocks(b, sums=(), most=(), least=()):
    """b with sums, maxima and minima of the last BLOCK bars: long frames are made of them, as a frame of n bars takes n steps a row."""
    f = w.rows(-(BLOCK - 1))
    each = {f"sum_{c}": F.when(F.count(c).over(f) == BLOCK, F.sum(c).over(f)) for c in sums} | {f"most_{c}": F.max(c).over(f) for c in most} | {f"least_{c}": F.min(c).over(f) for c in least}
    return b.select("*", *[v.alias(k) for k, v in each.items()])


def of_blocks(name: str, n: int):
    """The blocks that make up the last n bars; null before a name's first bar."""
    return [C(name), *[back(k, name) for k in range(BLOCK, n, BLOCK)]]


def mean(value: str, n: int):
    """Mean of the last n bars, once there are n."""
    first, *rest = of_blocks(f"sum_{value}", n)
    return sum(rest, first) / n


def step(a, b):
    return ratio(a, b) - 1


PACE = mo.register(Module("pace", (
    Metric("ret5", lambda: step(C("close"), back(5))), Metric("ret20", lambda: step(C("close"), back(20))), Metric("ret60", lambda: step(C("close"), back(60))), Metric("ret120", lambda: step(C("close"), back(120))),
    Metric("ret_skip", lambda: step(back(20), back(120))), Metric("from_high", lambda: step(C("close"), F.greatest(*of_blocks("most_high", 250)))), Metric("from_low", lambda: step(C("close"), F.least(*of_blocks("least_low", 250)))),
), lambda b: blocks(b, most=["high"], least=["low"])))
CALM = mo.register(Module("calm", (
    Metric("range1", lambda: C("range"), -1), Metric("range20", lambda: mean("range", 20), -1), Metric("move20", lambda: F.when(F.count("day").over(w.rows(-19)) == 20, F.stddev_samp("day").over(w.rows(-19))), -1),
    Metric("worst20", lambda: F.min("day").over(w.rows(-19))), Metric("bars_used", lambda: F.count("*").over(w.rows(-249)).cast("double"), signal=False),
), lambda b: blocks(b.withColumn("range", ratio(C("high") - C("low"), C("close"))).withColumn("day", step(C("close"), back(1))), ["range"])))
FLOW = mo.register(Module("flow", (
    Metric("traded", lambda: C("worth")), Metric("traded20", lambda: mean("worth", 20)), Metric("surge", lambda: ratio(C("volume"), mean("volume", 60))), Metric("trades20", lambda: mean("trades", 20)), Metric("lot", lambda: ratio(C("volume"), C("trades")), -1),
), lambda b: blocks(b.withColumn("worth", C("close") * C("volume")), ["worth", "volume", "trades"])))
TREND = mo.register(Module("trend", (
    Metric("over20", lambda: step(C("close"), mean("close", 20))), Metric("over50", lambda: step(C("close"), mean("close", 50))), Metric("over200", lambda: step(C("close"), mean("close", 200))), Metric("crossing", lambda: step(mean("close", 20), mean("close", 100))),
    Metric("gap", lambda: step(C("open"), back(1))), Metric("body", lambda: step(C("close"), C("open"))), Metric("in_range", lambda: ratio(C("close") - C("low"), C("high") - C("low"))),
), lambda b: blocks(b, ["close"])))
MODULES = [PACE, CALM, FLOW, TREND]
OUTCOMES = {"fwd5": 5, "fwd20": 20}
SPACING = 20


def sql_mean(v: str, n: int) -> str:
    return f"CASE WHEN count({v}) OVER (f ROWS {n - 1} PRECEDING) = {n} THEN avg({v}) OVER (f ROWS {n - 1} PRECEDING) END"


#: The metrics in SQL, for the checks.
AS_SQL = {
    **{f"ret{n}": f"close / lag(close, {n}) OVER f - 1" for n in (5, 20, 60, 120)}, "ret_skip": "lag(close, 20) OVER f / lag(close, 120) OVER f - 1", "from_high": "close / max(high) OVER (f ROWS 249 PRECEDING) - 1", "from_low": "close / min(low) OVER (f ROWS 249 PRECEDING) - 1",
    "range1": "rng", "range20": sql_mean("rng", 20), "move20": "CASE WHEN count(day) OVER (f ROWS 19 PRECEDING) = 20 THEN stddev_samp(day) OVER (f ROWS 19 PRECEDING) END", "worst20": "min(day) OVER (f ROWS 19 PRECEDING)",
    "traded": "worth", "traded20": sql_mean("worth", 20), "surge": f"volume / ({sql_mean('volume', 60)})", "trades20": sql_mean("trades", 20), "lot": "volume / trades",
    **{f"over{n}": f"close / ({sql_mean('close', n)}) - 1" for n in (20, 50, 200)}, "crossing": f"({sql_mean('close', 20)}) / ({sql_mean('close', 100)}) - 1", "gap": "open / lag(close) OVER f - 1", "body": "close / open - 1", "in_range": "(close - low) / nullif(high - low, 0)",
}
SCORES = f"""{BARS}, {CALENDAR}, b AS (SELECT *, (high - low) / close AS rng, close / lag(close) OVER ({T}) - 1 AS day, close * volume AS worth FROM bars),
s AS (SELECT ticker, session, lead(close, 5) OVER f / lead(open) OVER f - 1 AS fwd5, lead(close, 20) OVER f / lead(open) OVER f - 1 AS fwd20, {", ".join(f"{v} AS {k}" for k, v in AS_SQL.items())} FROM b WINDOW f AS ({T})),
g AS (SELECT s.* FROM s JOIN cal USING (session) WHERE session_idx % {SPACING} = 1), l AS (SELECT ticker, session, fwd5, fwd20, metric, CAST(value AS DOUBLE) AS value FROM (SELECT ticker, session, fwd5, fwd20, {", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in AS_SQL)} FROM g) UNPIVOT (value FOR metric IN ({", ".join(AS_SQL)})))"""
THEMES = f"CASE {' '.join(f'''WHEN metric = '{x.name}' THEN '{m.name}' ''' for m in MODULES for x in m.metrics)} END"
KEYS = "metric, horizon, session"
#: Rows (metric, horizon, n_dates, ic, t, hit, ic_random, spread, names) from l.
PROOF = f"""e AS (SELECT ticker, session, metric, value, 5 AS horizon, fwd5 AS fwd FROM l WHERE fwd5 IS NOT NULL UNION ALL SELECT ticker, session, metric, value, 20, fwd20 FROM l WHERE fwd20 IS NOT NULL),
k AS (SELECT *, {avg_rank('value', KEYS)} AS a, {avg_rank('fwd', KEYS)} AS b, {avg_rank('draw', KEYS)} AS c, (row_number() OVER (PARTITION BY {KEYS} ORDER BY value, ticker) - 1) * 5 // count(*) OVER (PARTITION BY {KEYS}) AS bin FROM (SELECT *, CAST('0x' || md5('1|' || ticker || '|' || session || '|' || metric)[1:8] AS BIGINT) AS draw FROM e)),
i AS (SELECT metric, horizon, session, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic, CASE WHEN count(*) >= 5 AND stddev_pop(b) > 0 THEN corr(c, b) END AS noise, CASE WHEN count(*) >= 15 THEN avg(fwd) FILTER (bin = 4) - avg(fwd) FILTER (bin = 0) END AS spread FROM k GROUP BY 1, 2, 3),
proof AS (SELECT metric, horizon, count(ic) AS n_dates, avg(ic) AS ic, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(greatest(2, count(ic) / greatest(1.0, horizon / {SPACING}.0)))) END AS t, avg(CAST(ic > 1e-12 AS INT)) AS hit, avg(noise) FILTER (ic IS NOT NULL) AS ic_random, avg(spread) FILTER (ic IS NOT NULL) AS spread, avg(n) FILTER (ic IS NOT NULL) AS names FROM i GROUP BY 1, 2 HAVING count(ic) >= 10)"""


def scores(spark, d):
    """All signals of all modules on dates SPACING sessions apart, with what followed: one scan of the bars."""
    b = bars(spark, d).withColumn("fwd5", w.forward_return(5)).withColumn("fwd20", w.forward_return(20))
    dates = calendar(spark, d).where(F.col("session_idx") % SPACING == 1).select("session")
    plain = [x.name for m in MODULES for x in m.metrics if x.signal]
    return mo.wide(b, MODULES, list(OUTCOMES)).select("ticker", "session", *OUTCOMES, *plain).join(F.broadcast(dates), "session")  # a few dates a year


@query("K1_module_scores", f"WITH {SCORES} SELECT {THEMES} AS module, metric, ticker, session, round(value, 5) AS value FROM l")
def module_scores(spark, d):
    """The tidy score table that all modules declare."""
    return mo.tidy(scores(spark, d), MODULES, list(OUTCOMES)).select("module", "metric", "ticker", "session", r("value", "value", 5))


@query("E12_leaderboard", f"""WITH {SCORES}, {PROOF}, dates AS (SELECT session, row_number() OVER (ORDER BY session) AS i FROM (SELECT DISTINCT session FROM l)), best AS (SELECT metric, ticker, i FROM (SELECT metric, ticker, session, row_number() OVER (PARTITION BY metric, session ORDER BY value DESC, ticker) AS n FROM l) JOIN dates USING (session) WHERE n <= 10),
kept AS (SELECT a.metric, a.i, avg(CASE WHEN b.ticker IS NULL THEN 0 ELSE 1 END) AS kept FROM best a LEFT JOIN best b ON a.metric = b.metric AND a.ticker = b.ticker AND b.i = a.i - 1 WHERE a.i > 1 GROUP BY 1, 2), turn AS (SELECT metric, 1 - avg(kept) AS turnover FROM kept GROUP BY 1)
SELECT {THEMES} AS module, metric, horizon, n_dates, round(names, 4) AS names, round(ic, 6) AS ic, round(t, 4) AS t, round(hit, 6) AS hit, round(ic_random, 6) AS ic_random, round(spread, 6) AS spread, round(turnover, 6) AS turnover, row_number() OVER (PARTITION BY horizon ORDER BY abs(ic) DESC, metric) AS place FROM proof LEFT JOIN turn USING (metric)""")
def leaderboard(spark, d):
    """Every signal of every module at both horizons, by the size of its IC."""
    board = mo.leaderboard(mo.tidy(scores(spark, d), MODULES, list(OUTCOMES)), OUTCOMES, SPACING)
    of = F.create_map(*[F.lit(x) for m in MODULES for y in m.metrics for x in (y.name, m.name)])
    return board.select(F.element_at(of, C("metric")).alias("module"), "metric", "horizon", "n_dates", r("names", "names", 4), r("ic", "ic"), r("t", "t", 4), r("hit", "hit"), r("ic_random", "ic_random"), r("spread", "spread"), r("turnover", "turnover"), "place")


STRATEGIES = [Strategy("steady_rise", (("ret120", 1, 1.0), ("over50", 1, 0.5), ("range20", -1, 1.0))), Strategy("pullback", (("ret5", -1, 1.0), ("over200", 1, 1.0), ("traded20", 1, 0.5))), Strategy("quiet", (("move20", -1, 1.0), ("surge", -1, 0.5)))]


def strategy_sql() -> str:
    pct = lambda m: f"CASE WHEN {m} IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY {m} NULLS LAST) + (count(*) OVER (PARTITION BY session, {m}) - 1) / 2.0) / count({m}) OVER (PARTITION BY session) END"
    names = sorted({m for s in STRATEGIES for m, _, _ in s.inputs})
    one = lambda s: f"SELECT ticker, session, '{s.key}' AS strategy, " + " + ".join(f"coalesce({k} * ({m if x > 0 else f'1 - {m}'}), 0)" for m, x, k in s.inputs) + " AS num, " + " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {k} END" for m, _, k in s.inputs) + f" AS den, {sum(k for _, _, k in s.inputs) / 2} AS half FROM p"
    return f"WITH {SCORES}, p AS (SELECT ticker, session, {', '.join(f'{pct(m)} AS {m}' for m in names)} FROM g), x AS ({' UNION ALL '.join(map(one, STRATEGIES))}) SELECT ticker, session, strategy, round(100 * num / den, 5) AS score FROM x WHERE den >= half"


@query("K2_strategy_scores", strategy_sql())
def strategy_scores(spark, d):
    """Declared ranking models over the modules' metrics."""
    return mo.strategy_scores(scores(spark, d), STRATEGIES).select("ticker", "session", "strategy", r("score", "score", 5))


COMBO_SPLIT, COMBO_T = "1999-01-01", 1.0


@query("E92_combo_by_evidence", f"""WITH {SCORES.replace("l AS (SELECT ticker", "every AS (SELECT ticker", 1)}, l AS (SELECT * FROM every WHERE session < DATE '{COMBO_SPLIT}'), {PROOF}, used AS (SELECT metric, {THEMES} AS theme, t FROM proof WHERE horizon = 20 AND abs(t) >= {COMBO_T}), weights AS (SELECT theme, avg(abs(t)) AS weight FROM used GROUP BY 1), total AS (SELECT count(*) AS used, string_agg(metric, ',' ORDER BY metric) AS names FROM used),
q AS (SELECT ticker, session, theme, t, 100 * {avg_rank('value', 'session, metric')} / count(*) OVER (PARTITION BY session, metric) AS rank FROM every JOIN used USING (metric) WHERE session >= DATE '{COMBO_SPLIT}'), th AS (SELECT ticker, session, theme, avg(CASE WHEN t >= 0 THEN rank ELSE 100 - rank END) AS mean, count(*) AS k FROM q GROUP BY 1, 2, 3),
n AS (SELECT ticker, session, sum(mean * weight) / sum(weight) AS score, sum(k) AS k FROM th JOIN weights USING (theme) GROUP BY 1, 2), c AS (SELECT *, k / used AS coverage FROM n, total)
SELECT CAST(ticker AS VARCHAR) AS ticker, session, 'combo' AS metric, round(score, 5) AS value, CASE WHEN score < 20 THEN 'WEAK' WHEN score < 40 THEN 'SOFT' WHEN score < 60 THEN 'MIXED' WHEN score < 80 THEN 'GOOD' ELSE 'STRONG' END AS label FROM c WHERE coverage >= 0.5
UNION ALL SELECT CAST(ticker AS VARCHAR), session, 'combo_cov', round(coverage, 5), NULL FROM c UNION ALL SELECT '_ALL', session, 'combo_n', round(any_value(used) * 1.0, 5), any_value(names) FROM c GROUP BY session""")
def combo_by_evidence(spark, d):
    """Weights from the dates before the split score the dates after it: what is graded has not been fitted on."""
    long = stored(mo.tidy(scores(spark, d), MODULES, list(OUTCOMES)))
    proof = mo.evidence(long.where(C("session") < F.lit(COMBO_SPLIT)), OUTCOMES, SPACING).where((C("horizon") == 20) & (F.abs("t") >= COMBO_T))
    of = F.create_map(*[F.lit(x) for m in MODULES for y in m.metrics for x in (y.name, m.name)])
    out = mo.combo(long.where(C("session") >= F.lit(COMBO_SPLIT)), proof.withColumn("theme", F.element_at(of, C("metric"))))
    return out.select("ticker", "session", "metric", r("value", "value", 5), "label")
