"""Queries over cross-sections: ranks, thirds, information coefficients, group returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import correlation, rank_avg, rank_pct, ratio, welch_t
from barloom.operators import crosssection as cs
from barloom.operators import windows as w
from barloom.plans.catalog import query, r
from barloom.sources.roles import BARS, CALENDAR, SECTORS, bars, calendar, sectors

T = "PARTITION BY ticker ORDER BY session"
#: Twenty-bar momentum against forward returns: the metric and outcomes of most queries here.
X = f"""{BARS}, x AS (SELECT ticker, session, close / lag(close, 20) OVER f - 1 AS mom, volume, close * volume AS traded, lead(close, 5) OVER f / lead(open) OVER f - 1 AS fwd5, lead(close, 20) OVER f / lead(open) OVER f - 1 AS fwd20 FROM bars WINDOW f AS ({T})),
m AS (SELECT *, CAST(date_trunc('month', session) AS DATE) AS month FROM x)"""


def scored(spark, d):
    b = bars(spark, d)
    return b.select("ticker", "session", (ratio(F.col("close"), F.lag("close", 20).over(w.order())) - 1).alias("mom"), "volume", (F.col("close") * F.col("volume")).alias("traded"), w.forward_return(5).alias("fwd5"), w.forward_return(20).alias("fwd20"), F.trunc("session", "month").alias("month"))


def avg_rank(v: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


@query("E8_spearman_by_month", f"""WITH {X}, k AS (SELECT month, {avg_rank('mom', 'month')} AS a, {avg_rank('fwd5', 'month')} AS b FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL)
SELECT month, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(a, b) END, 6) AS ic FROM k GROUP BY 1""")
def spearman_by_month(spark, d):
    return cs.spearman_by(scored(spark, d), ["month"], "mom", "fwd5").select("month", "n", r("ic", "ic"))


@query("E7_ic_by_horizon", f"""WITH {X}, l AS (SELECT session, 'fwd5' AS h, mom, fwd5 AS y, 5 AS n FROM m UNION ALL SELECT session, 'fwd20', mom, fwd20, 20 FROM m), k AS (SELECT h, n, session, {avg_rank('mom', 'h, session')} AS a, {avg_rank('y', 'h, session')} AS b FROM l WHERE mom IS NOT NULL AND y IS NOT NULL),
s AS (SELECT h, any_value(n) AS n, session, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS ic FROM k GROUP BY h, session)
SELECT h, count(ic) AS n_dates, round(avg(ic), 6) AS ic, round(avg(ic) / (stddev_samp(ic) / sqrt(greatest(2, count(ic) / any_value(n)))), 4) AS t, round(avg(CAST(ic > 1e-12 AS INT)), 6) AS hit, round(avg(ic) / stddev_samp(ic), 6) AS ir FROM s GROUP BY 1""")
def ic_by_horizon(spark, d):
    tidy = scored(spark, d).unpivot(["ticker", "session", "mom"], ["fwd5", "fwd20"], "h", "fwd")
    series = cs.spearman_by(tidy, ["h", "session"], "mom", "fwd")
    horizon = F.when(F.col("h") == "fwd5", 5).otherwise(20)
    return cs.ic_summary(series, horizon, 1, ["h"]).select("h", "n_dates", r("ic", "ic"), r("t", "t", 4), r("hit", "hit"), r("ir", "ir"))


@query("E9_quantile_spread", f"""WITH {X}, k AS (SELECT month, fwd5, (row_number() OVER (PARTITION BY session ORDER BY mom, ticker) - 1) * 5 // count(*) OVER (PARTITION BY session) AS bin, count(*) OVER (PARTITION BY session) AS n, session FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL)
SELECT session, round(avg(fwd5) FILTER (bin = 4) - avg(fwd5) FILTER (bin = 0), 6) AS spread, count(*) AS n FROM k WHERE n >= 15 GROUP BY 1""")
def quantile_spread(spark, d):
    return cs.quantile_spread(scored(spark, d), ["session"], "mom", "fwd5").select("session", r("spread", "spread"), "n")


@query("E10_ic_by_sector", f"""WITH {X}, {SECTORS}, s AS (SELECT sector, month, mom, fwd5 FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL AND fwd5 IS NOT NULL), k AS (SELECT sector, month, {avg_rank('mom', 'sector, month')} AS a, {avg_rank('fwd5', 'sector, month')} AS b FROM s),
i AS (SELECT sector, month, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS ic FROM k GROUP BY 1, 2) SELECT sector, count(ic) AS n_dates, round(avg(ic), 6) AS ic, round(avg(CAST(ic > 1e-12 AS INT)), 6) AS hit FROM i GROUP BY 1""")
def ic_by_sector(spark, d):
    s = cs.spearman_by(scored(spark, d).join(sectors(spark, d), "ticker"), ["sector", "month"], "mom", "fwd5")
    return cs.ic_summary(s, 1, 1, ["sector"]).select("sector", "n_dates", r("ic", "ic"), r("hit", "hit"))


@query("E81_rank_pct", f"WITH {X} SELECT ticker, session, round({avg_rank('mom', 'session')} / count(*) OVER (PARTITION BY session), 6) AS rank FROM m WHERE mom IS NOT NULL")
def rank_share(spark, d):
    return scored(spark, d).where("mom is not null").select("ticker", "session", r(rank_pct("mom", "session"), "rank"))


@query("E13_size_terciles", f"""WITH {X}, q AS (SELECT ticker, session, traded, quantile_cont(traded, 1.0 / 3) OVER (PARTITION BY session) AS a, quantile_cont(traded, 2.0 / 3) OVER (PARTITION BY session) AS b, count(*) OVER (PARTITION BY session) AS n FROM m)
SELECT ticker, session, CASE WHEN traded > b THEN 'large' WHEN traded <= a THEN 'small' ELSE 'mid' END AS size FROM q WHERE n >= 10""")
def size_terciles(spark, d):
    x = scored(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("session"))).where("n >= 10")
    return cs.with_thirds(x, "traded", ["session"]).select("ticker", "session", F.element_at(F.array(F.lit("small"), F.lit("mid"), F.lit("large")), F.coalesce("third", F.lit(2))).alias("size"))  # without a price: mid


@query("E26_thirds_spread", f"""WITH {X}, q AS (SELECT *, quantile_cont(mom, 1.0 / 3) OVER (PARTITION BY session) AS a, quantile_cont(mom, 2.0 / 3) OVER (PARTITION BY session) AS b FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL)
SELECT session, round(avg(fwd5) FILTER (mom > b) - avg(fwd5) FILTER (mom <= a), 6) AS spread FROM q GROUP BY 1""")
def thirds_spread(spark, d):
    x = cs.with_thirds(scored(spark, d).where("mom is not null and fwd5 is not null"), "mom", ["session"])
    return x.groupBy("session").agg(r(F.avg(F.when(F.col("third") == 3, F.col("fwd5"))) - F.avg(F.when(F.col("third") == 1, F.col("fwd5"))), "spread"))


@query("E27_neutral_spread", f"""WITH {X}, c AS (SELECT *, CASE WHEN traded > quantile_cont(traded, 2.0 / 3) OVER (PARTITION BY month) THEN 3 WHEN traded <= quantile_cont(traded, 1.0 / 3) OVER (PARTITION BY month) THEN 1 ELSE 2 END AS c FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL),
s AS (SELECT *, CASE WHEN mom > quantile_cont(mom, 2.0 / 3) OVER (PARTITION BY month, c) THEN 3 WHEN mom <= quantile_cont(mom, 1.0 / 3) OVER (PARTITION BY month, c) THEN 1 ELSE 2 END AS s FROM c),
d AS (SELECT month, c, avg(fwd5) FILTER (s = 3) - avg(fwd5) FILTER (s = 1) AS d FROM s GROUP BY 1, 2) SELECT month, round(CASE WHEN count(d) >= 2 THEN avg(d) END, 6) AS spread FROM d GROUP BY 1""")
def neutral_spread(spark, d):
    x = scored(spark, d).where("mom is not null and fwd5 is not null")
    return cs.neutral_spread(x, "month", "mom", "traded", "fwd5").select("month", r("spread", "spread"))


@query("E32_group_returns", f"""WITH {X}, {SECTORS} SELECT session, sector, count(fwd5) AS members, round(CASE WHEN count(fwd5) >= 3 THEN avg(fwd5) END, 6) AS ret FROM m JOIN sectors USING (ticker) WHERE fwd5 IS NOT NULL GROUP BY 1, 2""")
def group_returns(spark, d):
    return cs.group_returns(scored(spark, d).join(sectors(spark, d), "ticker"), ["session", "sector"], "fwd5", 3).select("session", "sector", "members", r("ret", "ret"))


@query("E33_leave_one_out", f"""WITH {X}, {SECTORS}, j AS (SELECT ticker, session, fwd5, sum(fwd5) OVER g AS s, count(fwd5) OVER g AS n FROM m JOIN sectors USING (ticker) WINDOW g AS (PARTITION BY session, sector))
SELECT ticker, session, round(CASE WHEN n - CAST(fwd5 IS NOT NULL AS INT) >= 3 THEN (s - coalesce(fwd5, 0)) / (n - CAST(fwd5 IS NOT NULL AS INT)) END, 5) AS peers FROM j""")
def leave_one_out(spark, d):
    return cs.leave_one_out(scored(spark, d).join(sectors(spark, d), "ticker"), "fwd5", ["session", "sector"]).select("ticker", "session", r("peers", "peers", 5))


@query("E34_pool_return", f"""WITH {X}, q AS (SELECT ticker, session, fwd5, (row_number() OVER (PARTITION BY session ORDER BY traded, ticker) - 1) * 5 // count(*) OVER (PARTITION BY session) AS fifth FROM m)
SELECT session, CAST(fifth AS BIGINT) AS fifth, round(avg(fwd5), 6) AS pool FROM q WHERE fwd5 IS NOT NULL GROUP BY 1, 2""")
def pool_return(spark, d):
    day = Window.partitionBy("session")
    q = scored(spark, d).withColumn("fifth", F.floor(ratio((F.row_number().over(day.orderBy("traded", "ticker")) - 1) * 5, F.count("*").over(day))))
    return q.where("fwd5 is not null").groupBy("session", "fifth").agg(r(F.avg("fwd5"), "pool"))


@query("E37_composite", f"""WITH {X}, k AS (SELECT ticker, session, {avg_rank('mom', 'session')} / count(*) OVER (PARTITION BY session) AS a, {avg_rank('-volume', 'session')} / count(*) OVER (PARTITION BY session) AS b FROM m WHERE mom IS NOT NULL) SELECT ticker, session, round((0.7 * a + 0.3 * b) * 100, 4) AS score FROM k""")
def composite(spark, d):
    return cs.composite(scored(spark, d).where("mom is not null"), [("mom", 1, 0.7), ("volume", -1, 0.3)], "session").select("ticker", "session", r("score", "score", 4))


@query("E74_winsor_rank", f"""WITH {X}, {SECTORS}, j AS (SELECT ticker, month, sector, avg(mom) AS v FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL GROUP BY 1, 2, 3),
h AS (SELECT *, greatest(quantile_cont(v, 0.01) OVER (PARTITION BY month, sector), least(quantile_cont(v, 0.99) OVER (PARTITION BY month, sector), v)) AS s, greatest(quantile_cont(v, 0.01) OVER (PARTITION BY month), least(quantile_cont(v, 0.99) OVER (PARTITION BY month), v)) AS g, count(*) OVER (PARTITION BY month, sector) AS n FROM j)
SELECT ticker, month, round(CASE WHEN n >= 5 THEN {avg_rank('s', 'month, sector')} / n ELSE {avg_rank('g', 'month')} / count(*) OVER (PARTITION BY month) END, 5) AS rank FROM h""")
def winsor_rank(spark, d):
    j = scored(spark, d).where("mom is not null").join(sectors(spark, d), "ticker").groupBy("ticker", "month", "sector").agg(F.avg("mom").alias("v"))
    return cs.winsor_rank(j, "v", "sector", "month").select("ticker", "month", r("rank", "rank", 5))


@query("E11_turnover", f"""WITH {X}, j AS (SELECT ticker, month, avg(mom) AS v FROM m WHERE mom IS NOT NULL GROUP BY 1, 2), k AS (SELECT ticker, month, datediff('month', DATE '1995-01-01', month) AS i, row_number() OVER (PARTITION BY month ORDER BY v DESC, ticker) AS n FROM j), t AS (SELECT * FROM k WHERE n <= 10)
SELECT a.month, round(1 - count(b.ticker) / count(*), 6) AS turnover FROM t a LEFT JOIN t b ON a.ticker = b.ticker AND b.i = a.i - 1 WHERE a.i > 1 GROUP BY 1""")
def turnover(spark, d):
    j = scored(spark, d).where("mom is not null").groupBy("ticker", "month").agg(F.avg("mom").alias("v")).withColumn("i", F.months_between("month", F.lit("1995-01-01")).cast("int"))
    return cs.turnover(j, "month", "v", 10, "i").select("month", r("turnover", "turnover"))


@query("E25_welch", f"""WITH {X}, {SECTORS}, j AS (SELECT sector, fwd5 AS v, mom > 0 AS up FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL AND fwd5 IS NOT NULL)
SELECT sector, round((avg(v) FILTER (up) - avg(v) FILTER (NOT up)) / sqrt(var_samp(v) FILTER (up) / count(*) FILTER (up) + var_samp(v) FILTER (NOT up) / count(*) FILTER (NOT up)), 4) AS t FROM j GROUP BY 1""")
def welch(spark, d):
    j = scored(spark, d).where("mom is not null and fwd5 is not null").join(sectors(spark, d), "ticker")
    return j.groupBy("sector").agg(r(welch_t(F.col("fwd5"), F.col("mom") > 0), "t", 4))


@query("E20_event_t", f"""WITH {X}, q AS (SELECT date_trunc('quarter', session) AS q, avg(fwd5) AS v, count(fwd5) AS k FROM m WHERE mom > 0.5 GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS n, count(v) AS quarters, round(avg(v), 6) AS mean, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 4) AS t FROM q""")
def event_t(spark, d):
    return cs.session_t(scored(spark, d).where("mom > 0.5"), "session", "fwd5").select("n", "quarters", r("mean", "mean"), r("t", "t", 4))


@query("E22_newey_west", f"""WITH {X}, s AS (SELECT month, avg(fwd5) AS v FROM m WHERE mom > 0 GROUP BY 1), c AS (SELECT month, v - avg(v) OVER () AS e, v FROM s WHERE v IS NOT NULL), l AS (SELECT v, e, lag(e) OVER (ORDER BY month) AS p FROM c)
SELECT count(*) AS n, round(avg(v) / sqrt((sum(e * e) / count(*) + sum(e * p) / count(*)) / count(*)), 4) AS t FROM l""")
def newey_west(spark, d):
    """A series of month means: some rows a year, whatever the data."""
    s = scored(spark, d).where("mom > 0").groupBy("month").agg(F.avg("fwd5").alias("v")).where("v is not null")
    everything = Window.partitionBy(F.lit(1))
    c = s.withColumn("e", F.col("v") - F.avg("v").over(everything)).withColumn("p", F.lag("e").over(everything.orderBy("month")))
    n = F.count("*")
    return c.agg(n.alias("n"), r(ratio(F.avg("v"), F.sqrt(ratio(ratio(F.sum(F.col("e") * F.col("e")), n) + ratio(F.sum(F.col("e") * F.col("p")), n), n))), "t", 4))


@query("E46_lead_lag", f"""WITH {X}, {SECTORS}, g AS (SELECT sector, month, avg(fwd5) AS v FROM m JOIN sectors USING (ticker) WHERE fwd5 IS NOT NULL GROUP BY 1, 2)
SELECT a.sector AS leader, b.sector AS follower, count(*) AS n, round(corr(a.v, b.v), 5) AS c FROM g a JOIN g b ON b.month = a.month + INTERVAL 1 MONTH AND a.sector <> b.sector GROUP BY 1, 2""")
def lead_lag(spark, d):
    g = cs.group_returns(scored(spark, d).join(sectors(spark, d), "ticker"), ["sector", "month"], "fwd5", 1)
    a = g.select(F.col("sector").alias("leader"), F.col("ret").alias("x"), F.add_months("month", 1).alias("month"))
    b = g.select(F.col("sector").alias("follower"), F.col("ret").alias("y"), "month")
    return a.join(b, "month").where("leader <> follower").groupBy("leader", "follower").agg(F.count("*").alias("n"), r(correlation("x", "y"), "c", 5))


@query("E48_quadrants", f"""WITH {X}, {SECTORS}, g AS (SELECT sector, month, avg(mom) AS v FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL GROUP BY 1, 2), c AS (SELECT sector, month, v - avg(v) OVER (PARTITION BY month) AS rel FROM g), p AS (SELECT *, lag(rel) OVER (PARTITION BY sector ORDER BY month) AS prev FROM c)
SELECT sector, month, CASE WHEN rel > 0 AND rel >= prev THEN 'leading' WHEN rel > 0 THEN 'weakening' WHEN rel < prev THEN 'lagging' ELSE 'improving' END AS quadrant FROM p WHERE prev IS NOT NULL""")
def quadrants(spark, d):
    g = scored(spark, d).where("mom is not null").join(sectors(spark, d), "ticker").groupBy("sector", "month").agg(F.avg("mom").alias("v"))
    g = g.withColumn("rel", F.col("v") - F.avg("v").over(Window.partitionBy("month")))
    g = g.withColumn("prev", F.lag("rel").over(Window.partitionBy("sector").orderBy("month"))).where("prev is not null")
    return g.select("sector", "month", F.expr("case when rel > 0 and rel >= prev then 'leading' when rel > 0 then 'weakening' when rel < prev then 'lagging' else 'improving' end").alias("quadrant"))


@query("E98_topn_backtest", f"""WITH {X}, k AS (SELECT session, fwd5, row_number() OVER (PARTITION BY session ORDER BY mom DESC, ticker) AS n FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL) SELECT session, round(avg(fwd5) FILTER (n <= 5) - avg(fwd5), 6) AS edge FROM k GROUP BY 1""")
def topn_backtest(spark, d):
    x = scored(spark, d).where("mom is not null and fwd5 is not null").withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("mom"), "ticker")))
    return x.groupBy("session").agg(r(F.avg(F.when(F.col("n") <= 5, F.col("fwd5"))) - F.avg("fwd5"), "edge"))


@query("E107_metric_audit", f"""WITH {X} SELECT count(*) AS n, count(mom) AS held, count(DISTINCT round(mom, 3)) AS kinds, round(min(mom), 6) AS low, round(max(mom), 6) AS high FROM m""")
def metric_audit(spark, d):
    return scored(spark, d).agg(F.count("*").alias("n"), F.count("mom").alias("held"), F.countDistinct(F.round(F.col("mom") + 1e-9, 3)).alias("kinds"), r(F.min("mom"), "low"), r(F.max("mom"), "high"))


@query("G3_top_per_session", f"""WITH {X}, k AS (SELECT session, ticker, row_number() OVER (PARTITION BY session ORDER BY mom DESC, ticker) AS n FROM m WHERE mom IS NOT NULL) SELECT session, ticker, CAST(n AS BIGINT) AS n FROM k WHERE n <= 3""")
def top_per_session(spark, d):
    n = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("mom"), "ticker"))
    return scored(spark, d).where("mom is not null").withColumn("n", n.cast("long")).where("n <= 3").select("session", "ticker", "n")


@query("E96_pivot_scores", f"""WITH {X}, s AS (SELECT ticker, month, avg(mom) AS mom, avg(fwd5) AS fwd5, avg(traded) AS traded FROM m GROUP BY 1, 2) SELECT ticker, month, round(mom, 6) AS mom, round(fwd5, 6) AS fwd5, round(traded, 2) AS traded FROM s WHERE mom IS NOT NULL OR fwd5 IS NOT NULL OR traded IS NOT NULL""")
def pivot_scores(spark, d):
    """Wide to long and back, as the score store does."""
    wide = scored(spark, d).groupBy("ticker", "month").agg(F.avg("mom").alias("mom"), F.avg("fwd5").alias("fwd5"), F.avg("traded").alias("traded"))
    tidy = wide.unpivot(["ticker", "month"], ["mom", "fwd5", "traded"], "metric", "value").where("value is not null")
    back = tidy.groupBy("ticker", "month").pivot("metric", ["mom", "fwd5", "traded"]).agg(F.max("value"))
    return back.select("ticker", "month", r("mom", "mom"), r("fwd5", "fwd5"), r("traded", "traded", 2))


@query("E102_metric_evidence", f"""WITH {X}, l AS (SELECT session, 'mom' AS metric, mom AS v, fwd5 FROM m UNION ALL SELECT session, 'traded', traded, fwd5 FROM m), k AS (SELECT metric, session, {avg_rank('v', 'metric, session')} AS a, {avg_rank('fwd5', 'metric, session')} AS b FROM l WHERE v IS NOT NULL AND fwd5 IS NOT NULL),
s AS (SELECT metric, session, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS ic FROM k GROUP BY 1, 2) SELECT metric, count(ic) AS n_dates, round(avg(ic), 6) AS ic FROM s GROUP BY 1""")
def metric_evidence(spark, d):
    tidy = scored(spark, d).unpivot(["ticker", "session", "fwd5"], ["mom", "traded"], "metric", "value")
    s = cs.spearman_by(tidy, ["metric", "session"], "value", "fwd5")
    return cs.ic_summary(s, 5, 1, ["metric"]).select("metric", "n_dates", r("ic", "ic"))


@query("D2_size_asof", f"""WITH {X}, {CALENDAR}, g AS (SELECT session AS grid FROM cal WHERE session_idx % 60 = 0), t AS (SELECT DISTINCT ticker FROM m) SELECT t.ticker, g.grid, round(x.traded, 4) AS traded FROM g CROSS JOIN t ASOF LEFT JOIN m x ON x.ticker = t.ticker AND x.session <= g.grid""")
def size_asof(spark, d):
    from barloom.operators.asof import backward

    grid = calendar(spark, d).where("session_idx % 60 = 0").select(F.col("session").alias("grid"))
    x = scored(spark, d)
    left = x.select("ticker").distinct().join(F.broadcast(grid), how="cross")  # grid dates: a few a year
    return backward(left, x, "ticker", "grid", "session", ["traded"]).select("ticker", "grid", r("traded", "traded", 4))


@query("E41_rank_ties", f"WITH {X} SELECT ticker, session, round({avg_rank('volume', 'session')}, 4) AS rank FROM m")
def rank_ties(spark, d):
    return scored(spark, d).select("ticker", "session", r(rank_avg("volume", "session"), "rank", 4))
