"""Further queries: macro panels, calibration, themes, verdicts, seams and screens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import clip, correlation, rank_avg, rank_pct, ratio, safe_divide, t_stat, tier
from barloom.operators import backtest as bt
from barloom.operators import crosssection as cs
from barloom.operators import themes
from barloom.operators import windows as w
from barloom.plans.bar_plans import PATHS, rule_sql
from barloom.plans.catalog import query, r
from barloom.plans.company_plans import STATEMENT, pair, statement
from barloom.plans.cross_plans import X, avg_rank, scored
from barloom.plans.event_plans import TRADES, trades
from barloom.sources.roles import BARS, CALENDAR, SECTORS, bars, calendar, dealt, parts, sectors, table

T = "PARTITION BY ticker ORDER BY session"


@query("E3_strength", f"WITH {BARS} SELECT ticker, session, round(close / lag(close, 21) OVER ({T}) - 1, 6) AS strength FROM bars")
def strength(spark, d):
    return bars(spark, d).select("ticker", "session", r(ratio(F.col("close"), F.lag("close", 21).over(w.order())) - 1, "strength"))


MACRO = f"""{BARS}, {SECTORS}, s AS (SELECT sector, session, avg(close) AS v FROM bars JOIN sectors USING (ticker) GROUP BY 1, 2), p AS (SELECT session, max(v) FILTER (sector = 'ASIA') AS asia, max(v) FILTER (sector = 'EUROPE') AS europe, max(v) FILTER (sector = 'AMERICA') AS america FROM s GROUP BY 1)"""


@query("E4_macro_panel", f"""WITH {MACRO}, f AS (SELECT session, last_value(asia IGNORE NULLS) OVER o AS asia, last_value(europe IGNORE NULLS) OVER o AS europe, last_value(america IGNORE NULLS) OVER o AS america FROM p WINDOW o AS (ORDER BY session))
SELECT session, round(asia, 5) AS asia, round(europe, 5) AS europe, round(america, 5) AS america, round(asia / lag(asia, 20) OVER (ORDER BY session) - 1, 5) AS asia20 FROM f""")
def macro_panel(spark, d):
    """One row a session: gaps filled forward, twenty-session changes. Sessions are few, whatever the data."""
    s = bars(spark, d).join(sectors(spark, d), "ticker").groupBy("session").pivot("sector", ["ASIA", "EUROPE", "AMERICA"]).agg(F.avg("close"))
    o = Window.partitionBy(F.lit(1)).orderBy("session")
    f = s.select("session", *[F.last(c, ignorenulls=True).over(o).alias(c.lower()) for c in ("ASIA", "EUROPE", "AMERICA")])
    return f.select("session", *[r(c, c, 5) for c in ("asia", "europe", "america")], r(ratio(F.col("asia"), F.lag("asia", 20).over(o)) - 1, "asia20", 5))


CAL = f"""{BARS}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({T})), 0), coalesce(abs(low - lag(close) OVER ({T})), 0)) AS tr FROM bars),
a AS (SELECT ticker, session, close / open - 1 AS ret, CASE WHEN count(tr) OVER f >= 7 THEN avg(tr) OVER f END / close AS atr FROM tr WINDOW f AS ({T} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
{TRADES}, j AS (SELECT role AS event_type, least(20, abs(ret) / atr) AS x FROM a JOIN trades ON trades.issuer + 1 = a.ticker AND trades.filed = a.session WHERE atr > 0)"""


@query("E5_severity_calibration", f"""WITH {CAL} SELECT event_type, count(*) AS n, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.9), 5) AS p90, round(quantile_cont(x, 0.5) / nullif((SELECT quantile_cont(x, 0.5) FROM j), 0), 5) AS lift FROM j GROUP BY 1""")
def severity_calibration(spark, d):
    a = w.with_atr(bars(spark, d), 14, 7, lag=1).withColumn("ret", ratio(F.col("close"), F.col("open")) - 1).withColumn("rel", ratio(F.col("atr"), F.col("close"))).where("rel > 0")
    e = trades(spark, d).select((F.col("issuer") + 1).alias("ticker"), F.col("filed").alias("session"), F.col("role").alias("event_type"))
    j = a.join(e, ["ticker", "session"]).withColumn("x", F.least(F.lit(20.0), F.try_divide(F.abs("ret"), F.col("rel"))))
    everything = j.agg(F.percentile("x", F.lit(0.5)).alias("all"))
    out = j.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.9)).alias("p90")).join(F.broadcast(everything), how="cross")  # one row
    return out.select("event_type", "n", r("mean", "mean", 5), r("median", "median", 5), r("p90", "p90", 5), r(F.try_divide("median", "all"), "lift", 5))


@query("E14_best_metric", f"""WITH {X}, l AS (SELECT month, 'mom' AS metric, mom AS v, fwd5 FROM m UNION ALL SELECT month, 'volume', volume, fwd5 FROM m UNION ALL SELECT month, 'traded', traded, fwd5 FROM m), k AS (SELECT metric, month, {avg_rank('v', 'metric, month')} AS a, {avg_rank('fwd5', 'metric, month')} AS b FROM l WHERE v IS NOT NULL AND fwd5 IS NOT NULL),
s AS (SELECT metric, corr(a, b) AS ic FROM k GROUP BY metric, month HAVING count(*) >= 5), t AS (SELECT metric, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM s GROUP BY 1) SELECT metric, round(t, 4) AS t FROM t ORDER BY abs(t) DESC LIMIT 1""")
def best_metric(spark, d):
    tidy = scored(spark, d).unpivot(["ticker", "month", "fwd5"], ["mom", "volume", "traded"], "metric", "value")
    t = cs.spearman_by(tidy, ["metric", "month"], "value", "fwd5").groupBy("metric").agg(t_stat("ic").alias("t"))
    return t.orderBy(F.desc(F.abs("t")), "metric").limit(1).select("metric", r("t", "t", 4))


@query("E30_bucket_averages", f"""WITH {X} SELECT CASE WHEN mom < -0.3 THEN 'a' WHEN mom < 0 THEN 'b' WHEN mom < 0.3 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, round(avg(fwd5), 6) AS mean FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL GROUP BY 1""")
def bucket_averages(spark, d):
    x = scored(spark, d).where("mom is not null and fwd5 is not null").withColumn("bucket", tier(F.col("mom"), [(-0.3, "a"), (0, "b"), (0.3, "c")], "d"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), r(F.avg("fwd5"), "mean"))


@query("E31_rule_by_date", f"WITH {BARS}, {PATHS}, {rule_sql()} SELECT session, rule, count(*) AS n, round(avg(ret), 6) AS mean FROM x WHERE rule IN ('hold_5', 'stop2_hold20', 'trail_2') GROUP BY 1, 2")
def rule_by_date(spark, d):
    return bt.exits(bt.with_paths(bars(spark, d)), ["hold_5", "stop2_hold20", "trail_2"]).groupBy("session", "rule").agg(F.count("*").alias("n"), r(F.avg("ret"), "mean"))


@query("E38_group_ic", f"""WITH {X}, {SECTORS}, g AS (SELECT month, subind, avg(mom) AS a, avg(fwd20) AS b FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL AND fwd20 IS NOT NULL GROUP BY 1, 2), k AS (SELECT month, {avg_rank('a', 'month')} AS x, {avg_rank('b', 'month')} AS y FROM g) SELECT month, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(x, y) END, 6) AS ic FROM k GROUP BY 1""")
def group_ic(spark, d):
    g = scored(spark, d).where("mom is not null and fwd20 is not null").join(sectors(spark, d), "ticker").groupBy("month", "subind").agg(F.avg("mom").alias("a"), F.avg("fwd20").alias("b"))
    return cs.spearman_by(g, ["month"], "a", "b").select("month", "n", r("ic", "ic"))


@query("E42_lag_rank_profile", f"""WITH {X}, {SECTORS}, g AS (SELECT month, subind, avg(fwd5) AS v FROM m JOIN sectors USING (ticker) WHERE fwd5 IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, {avg_rank('v', 'month')} AS rk FROM g), l AS (SELECT unnest([1, 3, 12]) AS lag)
SELECT l.lag, count(*) AS n, round(corr(a.rk, b.rk), 5) AS c FROM l JOIN k a ON true JOIN k b ON b.subind = a.subind AND b.month = a.month + to_months(l.lag) GROUP BY 1""")
def lag_rank_profile(spark, d):
    g = scored(spark, d).where("fwd5 is not null").join(sectors(spark, d), "ticker").groupBy("month", "subind").agg(F.avg("fwd5").alias("v")).withColumn("rk", rank_avg("v", "month"))
    a = g.select("subind", F.col("rk").alias("x"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(12))).alias("lag"), "month").withColumn("month", F.expr("add_months(month, lag)"))
    return a.join(g.select("subind", "month", F.col("rk").alias("y")), ["subind", "month"]).groupBy("lag").agg(F.count("*").alias("n"), r(correlation("x", "y"), "c", 5))


@query("E45_longest_booms", f"""WITH {X}, {SECTORS}, g AS (SELECT month, sector, avg(fwd5) AS v FROM m JOIN sectors USING (ticker) WHERE fwd5 IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, sector) AS place, datediff('month', DATE '1990-01-01', month) AS i FROM g),
i AS (SELECT *, i - row_number() OVER (PARTITION BY sector ORDER BY i) AS island FROM k WHERE place <= 2) SELECT sector, min(month) AS first, count(*) AS months FROM i GROUP BY sector, island ORDER BY months DESC, sector, first LIMIT 10""")
def longest_booms(spark, d):
    g = scored(spark, d).where("fwd5 is not null").join(sectors(spark, d), "ticker").groupBy("month", "sector").agg(F.avg("fwd5").alias("v"))
    g = g.withColumn("hot", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("v"), "sector")) <= 2).withColumn("i", F.months_between("month", F.lit("1990-01-01")).cast("int"))
    runs = w.islands(g, "hot", 1, "run", by="sector", place="i").groupBy("sector", "run").agg(F.min("month").alias("first"), F.count("*").alias("months"))
    return runs.orderBy(F.desc("months"), "sector", "first").limit(10).select("sector", "first", "months")


@query("E54_issuer_signal", f"""WITH {TRADES} SELECT issuer, count(DISTINCT owner) AS buyers, round(sum(value), 2) AS value, bool_or(value > 300000) AS big FROM trades WHERE filed > DATE '2000-01-01' AND filed <= DATE '2000-06-30' GROUP BY 1 HAVING count(DISTINCT owner) >= 2""")
def issuer_signal(spark, d):
    t = trades(spark, d).where("filed > date'2000-01-01' and filed <= date'2000-06-30'")
    return t.groupBy("issuer").agg(F.countDistinct("owner").alias("buyers"), r(F.sum("value"), "value", 2), F.bool_or(F.col("value") > 300000).alias("big")).where("buyers >= 2")


@query("E56_sales_rollup", f"WITH {TRADES} SELECT owner, issuer, filed, arg_min(role, accession) AS role, round(sum(value), 2) AS value, max(value) AS top FROM trades GROUP BY 1, 2, 3")
def sales_rollup(spark, d):
    return trades(spark, d).groupBy("owner", "issuer", "filed").agg(F.min_by("role", "accession").alias("role"), r(F.sum("value"), "value", 2), F.max("value").alias("top"))


@query("E59_alias_tier", f"""WITH {TRADES}, a AS (SELECT owner, issuer, value, CASE role WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS tier FROM trades), m AS (SELECT *, min(tier) OVER (PARTITION BY owner, issuer) AS best FROM a) SELECT owner, issuer, CAST(best AS INT) AS tier, count(*) AS n, round(sum(value), 2) AS value FROM m WHERE tier = best GROUP BY 1, 2, 3""")
def alias_tier(spark, d):
    a = trades(spark, d).withColumn("tier", F.expr("case role when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end"))
    a = a.withColumn("best", F.min("tier").over(Window.partitionBy("owner", "issuer"))).where("tier = best")
    return a.groupBy("owner", "issuer", "tier").agg(F.count("*").alias("n"), r(F.sum("value"), "value", 2))


@query("E68_share_count", f"WITH {STATEMENT} SELECT cik, CAST(fy AS INT) AS fy, round(coalesce(CASE WHEN net_income >= 100000 THEN net_income END, CASE WHEN cfo >= 100000 THEN cfo END, CASE WHEN debt >= 100000 THEN debt END), 4) AS shares FROM s")
def share_count(spark, d):
    first = F.coalesce(*[F.when(F.col(c) >= 100000, F.col(c)) for c in ("net_income", "cfo", "debt")])
    return statement(spark, d).select("cik", "fy", r(first, "shares", 4))


@query("E73_growth_guarded", f"""WITH {STATEMENT} SELECT c.cik, CAST(c.fy AS INT) AS fy, round(CASE WHEN p.revenue > 0 THEN c.revenue / p.revenue - 1 END, 6) AS growth, round(CASE WHEN c.revenue > 0 THEN c.gross_profit / c.revenue END, 6) AS margin FROM s c LEFT JOIN s p ON p.cik = c.cik AND p.fy = c.fy - 1""")
def growth_guarded(spark, d):
    s = pair(spark, d)
    return s.select("cik", "fy", r(F.when(F.col("p_revenue") > 0, ratio(F.col("revenue"), F.col("p_revenue")) - 1), "growth"), r(F.when(F.col("revenue") > 0, ratio(F.col("gross_profit"), F.col("revenue"))), "margin"))


@query("E76_dupont", f"WITH {STATEMENT} SELECT cik, CAST(fy AS INT) AS fy, round(net_income / revenue, 6) AS margin, round(revenue / assets, 6) AS turnover, round(CASE WHEN (net_income - cfo) / assets IS NOT NULL THEN greatest(-1, least(1, (net_income - cfo) / assets)) END, 6) AS accruals FROM s")
def dupont(spark, d):
    s = statement(spark, d)
    return s.select("cik", "fy", r(safe_divide(F.col("net_income"), F.col("revenue")), "margin"), r(safe_divide(F.col("revenue"), F.col("assets")), "turnover"), r(clip(ratio(F.col("net_income") - F.col("cfo"), F.col("assets")), -1.0, 1.0), "accruals"))


@query("E78_momentum_12_1", f"""WITH {BARS}, {CALENDAR}, m AS (SELECT max(session_idx) AS m FROM cal), l AS (SELECT b.ticker, arg_max(close, session_idx) FILTER (session_idx <= m - 21) AS a, arg_max(close, session_idx) FILTER (session_idx <= m - 252) AS b FROM bars b JOIN cal USING (session), m GROUP BY 1) SELECT ticker, round(a / b - 1, 6) AS mom FROM l""")
def momentum_12_1(spark, d):
    """Positions in the calendar, not in a name's own rows."""
    cal = calendar(spark, d)
    j = bars(spark, d).join(cal, "session").join(F.broadcast(cal.agg(F.max("session_idx").alias("m"))), how="cross")  # one row
    upto = lambda n: F.max_by(F.when(F.col("session_idx") <= F.col("m") - n, F.col("close")), F.when(F.col("session_idx") <= F.col("m") - n, F.col("session_idx")))
    return j.groupBy("ticker").agg(upto(21).alias("a"), upto(252).alias("b")).select("ticker", r(ratio(F.col("a"), F.col("b")) - 1, "mom"))


@query("E82_sector_rollup", f"WITH {X}, {SECTORS} SELECT sector, month, count(mom) AS n, round(avg(mom), 6) AS mean FROM m JOIN sectors USING (ticker) GROUP BY 1, 2")
def sector_rollup(spark, d):
    return scored(spark, d).join(sectors(spark, d), "ticker").groupBy("sector", "month").agg(F.count("mom").alias("n"), r(F.avg("mom"), "mean"))


@query("E83_hype_surge", f"WITH {BARS} SELECT ticker, session, round(ln(avg(volume) OVER (f ROWS 20 PRECEDING) / avg(volume) OVER (f ROWS 251 PRECEDING)), 5) AS surge, round(close / avg(close) OVER (f ROWS 199 PRECEDING) - 1, 5) AS stretch FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY session)")
def hype_surge(spark, d):
    mean = lambda c, n: F.avg(c).over(w.rows(-(n - 1)))
    return bars(spark, d).select("ticker", "session", r(F.ln(ratio(mean("volume", 21), mean("volume", 252))), "surge", 5), r(ratio(F.col("close"), mean("close", 200)) - 1, "stretch", 5))


@query("E87_pillars", f"""WITH {X}, p AS (SELECT ticker, month, avg(mom) AS a, avg(volume) AS b, avg(traded) AS c FROM m GROUP BY 1, 2), k AS (SELECT ticker, month, CASE WHEN a IS NOT NULL THEN {avg_rank('a', 'month, a IS NULL')} / count(a) OVER (PARTITION BY month) END AS a, {avg_rank('b', 'month')} / count(*) OVER (PARTITION BY month) AS b, {avg_rank('c', 'month')} / count(*) OVER (PARTITION BY month) AS c FROM p)
SELECT ticker, month, round((coalesce(a, 0) + b + c) / (CAST(a IS NOT NULL AS INT) + 2) * 100, 4) AS score FROM k""")
def pillars(spark, d):
    p = scored(spark, d).groupBy("ticker", "month").agg(F.avg("mom").alias("a"), F.avg("volume").alias("b"), F.avg("traded").alias("c"))
    return themes.row_mean(p, {k: rank_pct(k, "month") for k in "abc"}, least_share=0.5, name="score").select("ticker", "month", r(F.col("score") * 100, "score", 4))


@query("E88_gated_rank", f"""WITH {X}, p AS (SELECT ticker, month, avg(mom) AS a, avg(traded) AS c FROM m WHERE mom IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, {avg_rank('c', 'month')} / count(*) OVER (PARTITION BY month) AS rc FROM p), g AS (SELECT * FROM k WHERE rc > 0.5) SELECT ticker, month, round({avg_rank('-a', 'month')} / count(*) OVER (PARTITION BY month), 6) AS dip FROM g""")
def gated_rank(spark, d):
    p = scored(spark, d).where("mom is not null").groupBy("ticker", "month").agg(F.avg("mom").alias("a"), F.avg("traded").alias("c"))
    inside = p.withColumn("rc", rank_pct("c", "month")).where("rc > 0.5")
    return inside.select("ticker", "month", r(rank_pct(-F.col("a"), "month"), "dip"))


CORRELATED = ["traded", "traded2", "volume", "mom"]


def dedup_sql() -> str:
    """The choice in order of preference, one table a step: a metric goes if its nearest kept one reaches 0.9."""
    ranks = ", ".join(f"{avg_rank(m, 'session')} AS {m}" for m in CORRELATED)
    pairs = ", ".join(f"abs(corr({a}, {b})) AS {a}_{b}" for i, a in enumerate(CORRELATED) for b in CORRELATED[:i])
    first, *rest = CORRELATED
    steps = [f"s0 AS (SELECT *, true AS keep_{first}, CAST(NULL AS VARCHAR) AS like_{first} FROM c)"]
    for i, a in enumerate(rest, 1):
        near = "[" + ", ".join(f"CASE WHEN keep_{b} THEN {{'c': {a}_{b}, 'k': '{b}'}} END" for b in CORRELATED[:i]) + "]"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (n), coalesce(n.c < 0.9, true) AS keep_{a}, CASE WHEN n.c >= 0.9 THEN n.k END AS like_{a} FROM (SELECT *, list_max({near}) AS n FROM s{i - 1}))")
    out = " UNION ALL ".join(f"SELECT '{a}' AS metric, keep_{a} AS kept, like_{a} AS \"like\" FROM s{len(rest)}" for a in CORRELATED)
    return f"WITH {X}, r AS (SELECT {ranks} FROM (SELECT *, traded * 2 + volume AS traded2 FROM m WHERE mom IS NOT NULL)), c AS (SELECT {pairs} FROM r), {', '.join(steps)} {out}"


@query("E91_correlation_dedup", dedup_sql())
def correlation_dedup(spark, d):
    metrics = scored(spark, d).where("mom is not null").select("ticker", "session", "mom", "volume", "traded", (F.col("traded") * 2 + F.col("volume")).alias("traded2"))
    metrics = dealt(metrics, parts(spark, d), "session")
    return themes.drop_correlated(metrics, CORRELATED, "session", 0.9)


@query("E94_strategy_coverage", f"WITH {X} SELECT count(*) FILTER (mom IS NOT NULL AND fwd5 IS NOT NULL) AS ranked, count(*) FILTER (mom IS NULL OR fwd5 IS NULL) AS dropped, count(*) FILTER (mom IS NULL) AS missing FROM m")
def strategy_coverage(spark, d):
    x = scored(spark, d)
    return x.agg(F.count_if(F.expr("mom is not null and fwd5 is not null")).alias("ranked"), F.count_if(F.expr("mom is null or fwd5 is null")).alias("dropped"), F.count_if(F.expr("mom is null")).alias("missing"))


@query("E97_watchlist", f"""WITH {BARS}, k AS (SELECT *, first_value(close) OVER ({T}) AS first_close FROM bars) SELECT ticker, session, round(close / first_close - 1, 6) AS since, round(max(close) OVER ({T}), 6) AS best, bool_or(close < 0.5 * first_close) OVER ({T}) AS failed FROM k""")
def watchlist(spark, d):
    """Every name from its first bar on: gain since, best close, whether a close fell under half the first."""
    o = w.order()
    b = bars(spark, d).withColumn("first_close", F.first("close").over(o))
    return b.select("ticker", "session", r(ratio(F.col("close"), F.col("first_close")) - 1, "since"), r(F.max("close").over(o), "best"), F.bool_or(F.col("close") < 0.5 * F.col("first_close")).over(o).alias("failed"))


@query("E97_watchlist_all", f"""WITH {BARS}, k AS (SELECT *, first_value(close) OVER ({T}) AS entry FROM bars), s AS (SELECT ticker, session, close / entry - 1 AS since, max(close) OVER ({T}) AS best, min(low) OVER ({T}) AS worst, bool_or(low < 0.5 * entry) OVER ({T}) AS failed FROM k)
SELECT ticker, session, round(since, 6) AS since, round(best, 6) AS best, round(worst, 6) AS worst, failed, round(since - avg(since) OVER (PARTITION BY session), 6) AS ahead FROM s""")
def watchlist_all(spark, d):
    """Every name from its first bar on: best close, worst low, whether a low fell under half the entry, and the lead over the mean of all names."""
    o = w.order()
    b = bars(spark, d).withColumn("entry", F.first("close").over(o))
    s = b.select("ticker", "session", (ratio(F.col("close"), F.col("entry")) - 1).alias("since"), F.max("close").over(o).alias("best"), F.min("low").over(o).alias("worst"), F.bool_or(F.col("low") < 0.5 * F.col("entry")).over(o).alias("failed"))
    return s.select("ticker", "session", r("since", "since"), r("best", "best"), r("worst", "worst"), "failed", r(F.col("since") - F.avg("since").over(Window.partitionBy("session")), "ahead"))


@query("E100_walk_forward", f"""WITH {X}, l AS (SELECT month, fwd5, metric, value FROM (SELECT month, fwd5, mom, CAST(volume AS DOUBLE) AS volume, traded FROM m WHERE fwd5 IS NOT NULL) UNPIVOT (value FOR metric IN (mom, volume, traded))), k AS (SELECT metric, month, {avg_rank('value', 'metric, month')} AS a, {avg_rank('fwd5', 'metric, month')} AS b FROM l),
s AS (SELECT metric, month, corr(a, b) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0), n AS (SELECT *, dense_rank() OVER (ORDER BY month) - 1 AS i, (SELECT count(DISTINCT month) FROM s) AS n FROM s), f AS (SELECT fold, i0 + (n - i0) * fold // 4 AS a, i0 + (n - i0) * (fold + 1) // 4 AS b FROM (SELECT DISTINCT n, CAST(floor(n * 0.4) AS BIGINT) AS i0 FROM n), (SELECT unnest(range(4)) AS fold)),
p AS (SELECT fold, metric, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t FROM f JOIN n ON n.i < f.a WHERE a < b GROUP BY 1, 2 HAVING count(*) >= 3), best AS (SELECT fold, metric, t, row_number() OVER (PARTITION BY fold ORDER BY abs(t) DESC, metric) AS k FROM p WHERE t IS NOT NULL)
SELECT CAST(best.fold AS INT) AS fold, best.metric AS chosen, count(*) AS n, round(avg(ic * sign(t)), 6) AS ic FROM best JOIN f USING (fold) JOIN n ON n.metric = best.metric AND n.i >= f.a AND n.i < f.b WHERE k = 1 GROUP BY 1, 2""")
def walk_forward(spark, d):
    return themes.walk_forward(scored(spark, d), ["mom", "volume", "traded"], "month", "fwd5", folds=4).select("fold", "chosen", "n", r("ic", "ic"))


@query("E104_decile_separators", f"""WITH {X}, q AS (SELECT *, (row_number() OVER (PARTITION BY month ORDER BY fwd5, ticker, session) - 1) * 10 // count(*) OVER (PARTITION BY month) AS dec FROM m WHERE fwd5 IS NOT NULL AND mom IS NOT NULL), l AS (SELECT dec, 'mom' AS k, mom AS v FROM q UNION ALL SELECT dec, 'traded', traded FROM q)
SELECT k AS metric, round((avg(v) FILTER (dec = 9) - avg(v) FILTER (dec = 0)) / sqrt(var_samp(v) FILTER (dec = 9) / count(v) FILTER (dec = 9) + var_samp(v) FILTER (dec = 0) / count(v) FILTER (dec = 0)), 4) AS t FROM l GROUP BY 1""")
def decile_separators(spark, d):
    from barloom.functions.ranks import welch_t

    m = Window.partitionBy("month")
    q = scored(spark, d).where("fwd5 is not null and mom is not null").withColumn("dec", F.floor(ratio((F.row_number().over(m.orderBy("fwd5", "ticker", "session")) - 1) * 10, F.count("*").over(m))))
    tidy = q.where("dec in (0, 9)").unpivot(["dec"], ["mom", "traded"], "metric", "value")
    return tidy.groupBy("metric").agg(r(welch_t(F.col("value"), F.col("dec") == 9), "t", 4))


@query("E117_top_per_group", f"WITH {X}, {SECTORS}, k AS (SELECT session, sector, ticker, row_number() OVER (PARTITION BY session, sector ORDER BY traded DESC, ticker) AS n FROM m JOIN sectors USING (ticker)) SELECT session, sector, ticker FROM k WHERE n <= 2")
def top_per_group(spark, d):
    n = F.row_number().over(Window.partitionBy("session", "sector").orderBy(F.desc("traded"), "ticker"))
    return scored(spark, d).join(sectors(spark, d), "ticker").withColumn("n", n).where("n <= 2").select("session", "sector", "ticker")


@query("E120_filter_combinations", f"""WITH {X}, f AS (SELECT *, mom > 0 AS a, traded > 20000 AS b, volume > 20 AS c FROM m WHERE mom IS NOT NULL AND fwd5 IS NOT NULL), s AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS mask) SELECT CAST(mask AS INT) AS mask, count(*) AS n, round(avg(fwd5) - (SELECT avg(fwd5) FROM f), 6) AS edge FROM f, s WHERE ((mask & 1) = 0 OR a) AND ((mask & 2) = 0 OR b) AND ((mask & 4) = 0 OR c) GROUP BY 1""")
def filter_combinations(spark, d):
    f = scored(spark, d).where("mom is not null and fwd5 is not null").selectExpr("fwd5", "mom > 0 as a", "traded > 20000 as b", "volume > 20 as c")
    return themes.subsets(f, ["a", "b", "c"], "fwd5").select("mask", "n", r("edge", "edge"))


@query("E127_seasonal_outlook", f"WITH {BARS}, m AS (SELECT ticker, CAST(date_trunc('month', session) AS DATE) AS month, arg_max(close, session) / arg_min(open, session) - 1 AS v FROM bars GROUP BY 1, 2) SELECT ticker, CAST(month(month) AS INT) AS moy, count(*) AS years, round(avg(v), 6) AS mean, round(avg(CAST(v > 0 AS INT)), 6) AS positive FROM m GROUP BY 1, 2")
def seasonal_outlook(spark, d):
    m = w.resample(bars(spark, d), "month").withColumn("v", ratio(F.col("close"), F.col("open")) - 1)
    return m.groupBy("ticker", F.month("period").alias("moy")).agg(F.count("*").alias("years"), r(F.avg("v"), "mean"), r(F.avg((F.col("v") > 0).cast("int")), "positive"))


@query("E138_breadth_terciles", f"""WITH {X}, {SECTORS}, g AS (SELECT session, subind, avg(CAST(mom > 0 AS INT)) AS v FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL GROUP BY 1, 2), k AS (SELECT session, subind, {avg_rank('v', 'session')} / count(*) OVER (PARTITION BY session) AS p FROM g) SELECT session, subind, CASE WHEN p > 2.0 / 3 THEN 3 WHEN p <= 1.0 / 3 THEN 1 ELSE 2 END AS state FROM k""")
def breadth_terciles(spark, d):
    g = scored(spark, d).where("mom is not null").join(sectors(spark, d), "ticker").groupBy("session", "subind").agg(F.avg((F.col("mom") > 0).cast("int")).alias("v"))
    p = g.withColumn("p", rank_pct("v", "session"))
    return p.select("session", "subind", F.when(F.col("p") > 2 / 3, 3).when(F.col("p") <= 1 / 3, 1).otherwise(2).alias("state"))


@query("F10_colored_average", f"WITH {BARS}, a AS (SELECT ticker, session, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f END AS v FROM bars WINDOW f AS ({T} ROWS 19 PRECEDING)), s AS (SELECT *, sign(v - lag(v) OVER ({T})) AS s FROM a) SELECT ticker, session, CASE WHEN s > 0 THEN 'up' WHEN s < 0 THEN 'down' END AS color, s <> lag(s) OVER ({T}) AS flipped FROM s")
def colored_average(spark, d):
    o = w.order()
    s = bars(spark, d).withColumn("v", w.sma("close", 20)).withColumn("s", F.sign(F.col("v") - F.lag("v").over(o)))
    return s.select("ticker", "session", F.when(F.col("s") > 0, "up").when(F.col("s") < 0, "down").alias("color"), (F.col("s") != F.lag("s").over(o)).alias("flipped"))


@query("F13_median_range", f"WITH {BARS}, tr AS (SELECT ticker, session, greatest(high - low, coalesce(abs(high - lag(close) OVER ({T})), 0), coalesce(abs(low - lag(close) OVER ({T})), 0)) / close AS v FROM bars) SELECT ticker, session, round(greatest(0.015, least(0.09, quantile_cont(v, 0.5) OVER ({T} ROWS 249 PRECEDING))), 6) AS scale FROM tr")
def median_range(spark, d):
    b = bars(spark, d).withColumn("v", ratio(w.true_range(), F.col("close")))
    m = w.with_rolling_quantile(b.select("ticker", "session", "v"), "v", 250, 0.5, "middle")
    return m.select("ticker", "session", r(clip(F.col("middle"), 0.015, 0.09), "scale"))


@query("F43_pattern_flags", f"WITH {BARS} SELECT ticker, session, min(low) OVER ({T} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > min(low) OVER ({T} ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING) AS higher_floor FROM bars")
def pattern_flags(spark, d):
    return bars(spark, d).select("ticker", "session", (F.min("low").over(w.rows(-19)) > F.min("low").over(w.rows(-79, -20))).alias("higher_floor"))


@query("F52_limit_entries", f"WITH {BARS}, {PATHS} SELECT j.ticker, j.session, round(any_value(b.close) * 0.98, 6) AS price, CAST(min(i) AS INT) AS bar FROM j JOIN bars b ON b.ticker = j.ticker AND b.session = j.session WHERE i <= 3 AND j.low <= b.close * (1 - 0.02) GROUP BY 1, 2")
def limit_entries(spark, d):
    p = bt.with_paths(bars(spark, d)).withColumn("x", bt.limit_fill(0.02))
    return p.where("x is not null").select("ticker", "session", r("x.price", "price"), F.col("x.bar").alias("bar"))


@query("F58_rotation", f"""WITH {X}, {SECTORS}, g AS (SELECT sector, month, avg(mom) AS v FROM m JOIN sectors USING (ticker) WHERE mom IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, sector) AS n FROM g) SELECT month, sector AS leader, round(v, 6) AS v FROM k WHERE n = 1""")
def rotation(spark, d):
    g = scored(spark, d).where("mom is not null").join(sectors(spark, d), "ticker").groupBy("sector", "month").agg(F.avg("mom").alias("v"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("v"), "sector"))).where("n = 1").select("month", F.col("sector").alias("leader"), r("v", "v"))


@query("I7_tiers", f"WITH {BARS} SELECT ticker, session, CASE WHEN close < 1000 THEN 'small' WHEN close < 1300 THEN 'mid' ELSE 'large' END AS exclusive, CASE WHEN trades <= 1 THEN 'one' WHEN trades <= 2 THEN 'two' ELSE 'many' END AS inclusive FROM bars")
def tiers(spark, d):
    return bars(spark, d).select("ticker", "session", tier(F.col("close"), [(1000, "small"), (1300, "mid")], "large").alias("exclusive"), tier(F.col("trades"), [(1, "one"), (2, "two")], "many", inclusive=True).alias("inclusive"))


@query("I23_calendar_math", f"WITH {CALENDAR} SELECT a.session, CAST(b.session_idx - a.session_idx AS BIGINT) AS ahead, b.session AS later FROM cal a JOIN cal b ON b.session_idx = least(a.session_idx + 10, (SELECT max(session_idx) FROM cal))")
def calendar_math(spark, d):
    cal = calendar(spark, d)
    last = cal.agg(F.max("session_idx").alias("m"))
    a = cal.join(F.broadcast(last), how="cross").withColumn("to", F.least(F.col("session_idx") + 10, F.col("m")))  # one row
    b = cal.select(F.col("session").alias("later"), F.col("session_idx").alias("to"))
    return a.join(b, "to").select("session", (F.col("to") - F.col("session_idx")).alias("ahead"), "later")


@query("I30_headline_pool", "WITH k AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) SELECT source, doc_id, n_chars FROM k WHERE n <= 3")
def headline_pool(spark, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("n", n).where("n <= 3").drop("n")


@query("H3_intersect", f"WITH {BARS} SELECT DISTINCT ticker FROM bars WHERE session < DATE '1996-01-01' INTERSECT SELECT DISTINCT ticker FROM bars WHERE session > DATE '2001-01-01'")
def intersect(spark, d):
    b = bars(spark, d)
    return b.where("session < date'1996-01-01'").select("ticker").intersect(b.where("session > date'2001-01-01'").select("ticker"))
