"""Queries of screens, labels, joins of newest states and small rules over bars, filings and facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_pct, ratio, tier
from barloom.operators import asof
from barloom.operators import windows as w
from barloom.plans.catalog import NUDGE, query, r
from barloom.plans.cross_plans import X, avg_rank, scored
from barloom.plans.event_plans import TRADES, trades
from barloom.sources.roles import BARS, CALENDAR, SECTORS, bars, calendar, dealt, parts, sectors, table

T = "PARTITION BY ticker ORDER BY session"
KEY = ["ticker", "session"]


@query("C4_tradeable", f"WITH {BARS} SELECT ticker, session, close >= 1000 AND quantile_cont(close * volume, 0.5) OVER f >= 25000 AND quantile_cont(trades, 0.5) OVER f >= 1 AS tradeable FROM bars WINDOW f AS ({T} ROWS 19 PRECEDING)")
def tradeable(spark, d):
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(w.rows(-19))
    ok = (F.col("close") >= 1000) & (middle(F.col("close") * F.col("volume")) >= 25000) & (middle("trades") >= 1)
    return bars(spark, d).select(*KEY, ok.alias("tradeable"))


@query("C7_suffix_verdict", "WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ABC.PRA' WHEN 1 THEN 'ABC.WS' WHEN 2 THEN 'ABC.B' WHEN 3 THEN 'ABC' WHEN 4 THEN 'ABC.U' ELSE 'ABC.RT' END AS symbol FROM part) SELECT p_partkey, NOT regexp_matches(symbol, '\\.(PR[A-Z]*|WS[AB]?|U|RT)$') AS kept FROM s")
def suffix_verdict(spark, d):
    s = F.expr("case p_partkey % 6 when 0 then 'ABC.PRA' when 1 then 'ABC.WS' when 2 then 'ABC.B' when 3 then 'ABC' when 4 then 'ABC.U' else 'ABC.RT' end")
    return table(spark, d, "part").select("p_partkey", (~s.rlike(r"\.(PR[A-Z]*|WS[AB]?|U|RT)$")).alias("kept"))


@query("C11_price_plausible", f"""WITH {TRADES}, p AS (SELECT a.accession, any_value(a.value) AS value, count(b.accession) AS n, quantile_cont(b.value, 0.5) AS mid FROM trades a LEFT JOIN trades b ON a.issuer = b.issuer AND b.owner <> a.owner AND b.filed BETWEEN a.filed - 15 AND a.filed + 15 GROUP BY 1) SELECT accession, CASE WHEN n >= 2 THEN value / mid BETWEEN 0.5 AND 2 ELSE value <= 200000 END AS plausible FROM p""")
def price_plausible(spark, d):
    p = asof.neighbours_within(trades(spark, d).drop("role"), "issuer", "filed", 15, "value", "owner")
    near = (ratio(F.col("value"), F.col("peer_median"))).between(0.5, 2)
    return p.select("accession", F.when(F.col("n_peers") >= 2, near).otherwise(F.col("value") <= 200000).alias("plausible"))


@query("C17_signals", f"""WITH {TRADES}, s AS (SELECT accession, unnest([CASE WHEN value > 200000 THEN 'large' END, CASE WHEN role = '1-URGENT' THEN 'chief' END, CASE WHEN owner % 7 = 0 AND value > 50000 THEN 'watched' END]) AS signal FROM trades) SELECT signal, count(*) AS n FROM s WHERE signal IS NOT NULL GROUP BY 1""")
def signals(spark, d):
    named = {"large": "value > 200000", "chief": "role = '1-URGENT'", "watched": "owner % 7 = 0 and value > 50000"}
    each = trades(spark, d).select(F.explode(F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in named.items()]))).alias("signal"))
    return each.groupBy("signal").agg(F.count("*").alias("n"))


@query("C18_regimes", f"""WITH {BARS}, m AS (SELECT session, avg(close) AS v FROM bars GROUP BY 1) SELECT session, v > avg(v) OVER (ORDER BY session ROWS 49 PRECEDING) AS above50, v / lag(v, 20) OVER (ORDER BY session) - 1 > 0.02 AS rising FROM m""")
def regimes(spark, d):
    """A series of sessions: few rows, whatever the data."""
    m = bars(spark, d).groupBy("session").agg(F.avg("close").alias("v"))
    o = Window.partitionBy(F.lit(1)).orderBy("session")
    return m.select("session", (F.col("v") > F.avg("v").over(o.rowsBetween(-49, 0))).alias("above50"), (ratio(F.col("v"), F.lag("v", 20).over(o)) - 1 > 0.02).alias("rising"))


@query("C19_rank_flags", f"WITH {X}, p AS (SELECT ticker, session, {avg_rank('mom', 'session')} / count(*) OVER (PARTITION BY session) AS a, {avg_rank('volume', 'session')} / count(*) OVER (PARTITION BY session) AS b FROM m WHERE mom IS NOT NULL) SELECT ticker, session, a > 0.8 AS hot, a > 0.8 AND b <= 0.5 AS quiet FROM p")
def rank_flags(spark, d):
    p = scored(spark, d).where("mom is not null").withColumn("a", rank_pct("mom", "session")).withColumn("b", rank_pct("volume", "session"))
    return p.select(*KEY, (F.col("a") > 0.8).alias("hot"), ((F.col("a") > 0.8) & (F.col("b") <= 0.5)).alias("quiet"))


@query("D4_latest_states", f"""WITH {X}, l AS (SELECT ticker, arg_max(mom, session) FILTER (mom IS NOT NULL) AS mom, max(session) FILTER (mom IS NOT NULL) AS seen FROM m WHERE session <= DATE '1999-06-30' GROUP BY 1), v AS (SELECT ticker, arg_max(volume, session) AS volume FROM m WHERE session <= DATE '1999-06-30' GROUP BY 1)
SELECT ticker, round(mom, 6) AS mom, seen, volume FROM l FULL JOIN v USING (ticker)""")
def latest_states(spark, d):
    """Each module's newest values by a date, side by side."""
    x = scored(spark, d).where("session <= date'1999-06-30'")
    a = asof.latest_by(x.where("mom is not null"), ["ticker"], [F.desc("session")]).select("ticker", "mom", F.col("session").alias("seen"))
    b = asof.latest_by(x, ["ticker"], [F.desc("session")]).select("ticker", "volume")
    return a.join(b, "ticker", "full_outer").select("ticker", r("mom", "mom"), "seen", "volume")


@query("D9_event_entry", f"""WITH {X}, {TRADES}, {CALENDAR}, e AS (SELECT accession, issuer + 1 AS ticker, (SELECT min(session) FROM cal WHERE session > filed) AS entry FROM trades) SELECT accession, e.ticker, entry, round(fwd5, 6) AS fwd5 FROM e JOIN m ON m.ticker = e.ticker AND m.session = e.entry""")
def event_entry(spark, d):
    """The first session after the event, and what the panel holds there."""
    t = trades(spark, d).select("accession", (F.col("issuer") + 1).alias("ticker"), "filed")
    e = asof.next_session(t, calendar(spark, d), "filed", "entry")
    return e.join(scored(spark, d).select("ticker", F.col("session").alias("entry"), "fwd5"), ["ticker", "entry"]).select("accession", "ticker", "entry", r("fwd5", "fwd5"))


@query("D20_beat_or_miss", f"""WITH {BARS}, n AS (SELECT ticker, session, close / lag(close) OVER ({T}) - 1 AS v FROM bars), c AS (SELECT ticker, session, CAST(v > 0.1 AS INT) AS beat, CAST(v < -0.1 AS INT) AS miss FROM n) SELECT ticker, session, CASE WHEN sum(beat) OVER f > sum(miss) OVER f THEN 1 WHEN sum(beat) OVER f < sum(miss) OVER f THEN -1 ELSE 0 END AS direction FROM c WINDOW f AS ({T} ROWS 1 PRECEDING)""")
def beat_or_miss(spark, d):
    v = ratio(F.col("close"), F.lag("close").over(w.order())) - 1
    c = bars(spark, d).withColumn("v", v).select(*KEY, (F.col("v") > 0.1).cast("int").alias("beat"), (F.col("v") < -0.1).cast("int").alias("miss"))
    f = w.rows(-1)
    gap = F.sum("beat").over(f) - F.sum("miss").over(f)
    return c.select(*KEY, F.when(gap > 0, 1).when(gap < 0, -1).otherwise(0).alias("direction"))


@query("D35_item_explode", "SELECT o_orderkey, unnest(string_split(CASE o_orderkey % 3 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '5.02' ELSE '1.01,2.03,9.01' END, ',')) AS item FROM orders")
def item_explode(spark, d):
    items = F.expr("case o_orderkey % 3 when 0 then '2.02,9.01' when 1 then '5.02' else '1.01,2.03,9.01' end")
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.split(items, ",")).alias("item"))


@query("D39_sector_forward", f"""WITH {X}, {SECTORS}, g AS (SELECT sector, session, avg(fwd5) AS sector_fwd FROM m JOIN sectors USING (ticker) GROUP BY 1, 2) SELECT ticker, session, round(fwd5 - sector_fwd, 6) AS excess FROM m JOIN sectors USING (ticker) JOIN g USING (sector, session) WHERE fwd5 IS NOT NULL""")
def sector_forward(spark, d):
    j = scored(spark, d).join(sectors(spark, d), "ticker")
    return j.withColumn("g", F.avg("fwd5").over(Window.partitionBy("sector", "session"))).where("fwd5 is not null").select(*KEY, r(F.col("fwd5") - F.col("g"), "excess"))


@query("D41_badges", f"""WITH {TRADES}, b AS (SELECT issuer, 'large purchase' AS why FROM trades WHERE value > 350000 UNION SELECT issuer, 'chief' FROM trades WHERE role = '1-URGENT' AND filed > DATE '2001-01-01') SELECT issuer, string_agg(why, '; ' ORDER BY why) AS reasons FROM b GROUP BY 1""")
def badges(spark, d):
    t = trades(spark, d)
    b = t.where("value > 350000").select("issuer", F.lit("large purchase").alias("why")).union(t.where("role = '1-URGENT' and filed > date'2001-01-01'").select("issuer", F.lit("chief")))
    return b.groupBy("issuer").agg(F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("reasons"))


@query("E18_outcomes_by_tag", f"""WITH {X}, {SECTORS} SELECT sector, quarter(session) AS q, count(*) AS n, round(quantile_cont(fwd20, 0.5), 6) AS median, round(avg(CAST(fwd20 > 0 AS INT)), 6) AS win FROM m JOIN sectors USING (ticker) WHERE fwd20 IS NOT NULL GROUP BY 1, 2""")
def outcomes_by_tag(spark, d):
    j = scored(spark, d).where("fwd20 is not null").join(sectors(spark, d), "ticker")
    return j.groupBy("sector", F.quarter("session").cast("long").alias("q")).agg(F.count("*").alias("n"), r(F.percentile("fwd20", F.lit(0.5)), "median"), r(F.avg((F.col("fwd20") > 0).cast("int")), "win"))


@query("E35_sector_components", f"""WITH {X}, {SECTORS}, b AS (SELECT ticker, session, mom, fwd5, CASE WHEN count(volume) OVER f = 50 THEN CAST(traded > avg(traded) OVER f AS INT) END AS up FROM m WINDOW f AS ({T} ROWS 49 PRECEDING)) SELECT sector, session, round(avg(mom), 6) AS mom, round(avg(up), 6) AS breadth, count(*) AS members FROM b JOIN sectors USING (ticker) GROUP BY 1, 2""")
def sector_components(spark, d):
    f = w.rows(-49)
    b = scored(spark, d).withColumn("up", F.when(F.count("volume").over(f) == 50, (F.col("traded") > F.avg("traded").over(f)).cast("int")))
    return b.join(sectors(spark, d), "ticker").groupBy("sector", "session").agg(r(F.avg("mom"), "mom"), r(F.avg("up"), "breadth"), F.count("*").alias("members"))


@query("E53_member_count", f"""WITH {TRADES}, d AS (SELECT DISTINCT role, filed AS day FROM trades) SELECT d.role, d.day, count(DISTINCT t.issuer) AS names FROM d JOIN trades t ON t.role = d.role AND t.filed > d.day - 10 AND t.filed <= d.day GROUP BY 1, 2""")
def member_count(spark, d):
    from barloom.operators.events import trailing_window

    return trailing_window(trades(spark, d), "role", "filed", 10, "issuer", "value").select("role", "day", "names")


@query("E55_owner_tracks", f"WITH {TRADES} SELECT owner, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN avg(value) END, 4) AS mean FROM trades WHERE filed + 60 <= DATE '2000-01-01' GROUP BY 1")
def owner_tracks(spark, d):
    return trades(spark, d).where("date_add(filed, 60) <= date'2000-01-01'").groupBy("owner").agg(F.count("*").alias("n"), r(F.when(F.count("*") >= 2, F.avg("value")), "mean", 4))


@query("E90_admission", f"""WITH {X}, l AS (SELECT month, 'mom' AS metric, mom AS v, fwd5 FROM m UNION ALL SELECT month, 'volume', volume, fwd5 FROM m), k AS (SELECT metric, month, {avg_rank('v', 'metric, month')} AS a, {avg_rank('fwd5', 'metric, month')} AS b FROM l WHERE v IS NOT NULL AND fwd5 IS NOT NULL), s AS (SELECT metric, corr(a, b) AS ic FROM k GROUP BY metric, month HAVING count(*) >= 5)
SELECT metric, count(ic) >= 20 AND abs(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))) >= 2 AS admitted FROM s GROUP BY 1""")
def admission(spark, d):
    from barloom.functions.ranks import t_stat
    from barloom.operators.crosssection import spearman_by

    tidy = scored(spark, d).unpivot(["ticker", "month", "fwd5"], ["mom", "volume"], "metric", "value")
    tidy = dealt(tidy, parts(spark, d), "metric", "month")
    return spearman_by(tidy, ["metric", "month"], "value", "fwd5").groupBy("metric").agg(((F.count("ic") >= 20) & (F.abs(t_stat("ic")) >= 2)).alias("admitted"))


@query("E93_strategy_rank", f"WITH {X}, k AS (SELECT ticker, session, mom, fwd5, traded FROM m), p AS (SELECT ticker, session, {avg_rank('mom', 'session')} / count(*) OVER (PARTITION BY session) AS a, {avg_rank('-traded', 'session')} / count(*) OVER (PARTITION BY session) AS b FROM k WHERE mom IS NOT NULL) SELECT ticker, session, CAST(rank() OVER (PARTITION BY session ORDER BY round(0.6 * a + 0.4 * b, 9) DESC) AS BIGINT) AS place FROM p")
def strategy_rank(spark, d):
    p = scored(spark, d).where("mom is not null").withColumn("a", rank_pct("mom", "session")).withColumn("b", rank_pct(-F.col("traded"), "session"))
    # Rounded as DuckDB does, by the product: decimal digits of a double, which F.round takes, fall otherwise at halves.
    score = F.floor((0.6 * F.col("a") + 0.4 * F.col("b") + NUDGE) * 1e9 + 0.5)
    return p.withColumn("s", score).select(*KEY, F.rank().over(Window.partitionBy("session").orderBy(F.desc("s"))).cast("long").alias("place"))


@query("E110_short_history", f"WITH {BARS}, p AS (SELECT ticker, count(*) AS n, quantile_cont(close * volume, 0.5) AS dv FROM bars GROUP BY 1) SELECT ticker, n FROM p WHERE n < 540 AND dv > 25000")
def short_history(spark, d):
    p = bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("dv"))
    return p.where("n < 540 and dv > 25000").select("ticker", "n")


@query("F26_low_after_peak", f"WITH {BARS}, p AS (SELECT ticker, arg_max(session, high) AS peak FROM (SELECT ticker, high, max(session) AS session FROM bars GROUP BY 1, 2) GROUP BY 1) SELECT b.ticker, p.peak, min(low) AS low FROM bars b JOIN p ON p.ticker = b.ticker AND b.session > p.peak GROUP BY 1, 2")
def low_after_peak(spark, d):
    b = bars(spark, d)
    p = asof.latest_by(b, ["ticker"], [F.desc("high"), F.desc("session")]).select("ticker", F.col("session").alias("peak"))
    return b.join(p, "ticker").where("session > peak").groupBy("ticker", "peak").agg(F.min("low").alias("low"))


@query("F30_extension_stage", f"WITH {BARS}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({T})), 0), coalesce(abs(low - lag(close) OVER ({T})), 0)) AS tr FROM bars), e AS (SELECT ticker, session, (close - min(low) OVER ({T} ROWS 59 PRECEDING)) / nullif(CASE WHEN count(tr) OVER f >= 7 THEN avg(tr) OVER f END, 0) AS x FROM tr WINDOW f AS ({T} ROWS 13 PRECEDING)) SELECT ticker, session, CASE WHEN x < 0.5 THEN 'TESTING' WHEN x < 1.5 THEN 'EARLY' WHEN x < 3 THEN 'CONFIRMED' WHEN x < 5 THEN 'LATE' WHEN x IS NOT NULL THEN 'EXTENDED' END AS stage FROM e")
def extension_stage(spark, d):
    b = w.with_atr(bars(spark, d)).withColumn("x", F.try_divide(F.col("close") - F.min("low").over(w.rows(-59)), F.col("atr")))
    return b.select(*KEY, tier(F.col("x"), [(0.5, "TESTING"), (1.5, "EARLY"), (3, "CONFIRMED"), (5, "LATE")], "EXTENDED").alias("stage"))


@query("F53_range20", f"WITH {BARS}, x AS (SELECT ticker, session, (greatest(high, coalesce(lag(close) OVER ({T}), high)) - least(low, coalesce(lag(close) OVER ({T}), low))) / close AS v FROM bars) SELECT ticker, session, round(CASE WHEN count(v) OVER f >= 15 THEN avg(v) OVER f END, 6) AS range20 FROM x WINDOW f AS ({T} ROWS 19 PRECEDING)")
def range20(spark, d):
    before = F.lag("close").over(w.order())
    x = bars(spark, d).withColumn("v", ratio(F.greatest("high", before) - F.least("low", before), F.col("close")))
    f = w.rows(-19)
    return x.select(*KEY, r(F.when(F.count("v").over(f) >= 15, F.avg("v").over(f)), "range20"))


@query("F68_trailing_counts", f"WITH {BARS}, x AS (SELECT ticker, session, CAST(coalesce(close / lag(close) OVER ({T}) - 1 > 0.2, false) AS INT) AS up FROM bars) SELECT ticker, session, CAST(sum(up) OVER ({T} ROWS 251 PRECEDING) AS BIGINT) AS n FROM x")
def trailing_counts(spark, d):
    up = F.coalesce((ratio(F.col("close"), F.lag("close").over(w.order())) - 1 > 0.2).cast("int"), F.lit(0))
    return bars(spark, d).withColumn("up", up).select(*KEY, F.sum("up").over(w.rows(-251)).alias("n"))


@query("F60_higher_lows", f"WITH {BARS}, x AS (SELECT *, low > lag(low) OVER ({T}) AS up FROM bars), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER ({T}) AS island FROM x) SELECT ticker, session, CAST(sum(CAST(coalesce(up, false) AS INT)) OVER (PARTITION BY ticker, island ORDER BY session) AS BIGINT) AS rising FROM g")
def higher_lows(spark, d):
    x = bars(spark, d).withColumn("up", F.coalesce(F.col("low") > F.lag("low").over(w.order()), F.lit(False)))
    g = x.withColumn("island", F.sum((~F.col("up")).cast("int")).over(w.order()))
    return g.select(*KEY, F.sum(F.col("up").cast("int")).over(Window.partitionBy("ticker", "island").orderBy("session")).alias("rising"))


@query("G6_near_misses", "WITH f AS (SELECT p_partkey, CAST(p_size < 10 AS INT) + CAST(p_retailprice < 1000 AS INT) + CAST(p_partkey % 5 = 0 AS INT) AS failed, p_retailprice FROM part) SELECT p_partkey FROM f WHERE failed = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def near_misses(spark, d):
    from barloom.operators.screening import failures

    gates = [("SIZE", "p_size >= 10"), ("PRICE", "p_retailprice >= 1000"), ("FIFTH", "p_partkey % 5 <> 0")]
    return table(spark, d, "part").withColumn("failed", failures(gates)).where(F.size("failed") == 1).orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey")


@query("I15_plausible_dates", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def plausible_dates(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.when(day.between("1996-01-01", "2000-12-31"), day).alias("day"))


@query("I24_breadth_labels", f"WITH {X}, b AS (SELECT session, avg(CAST(mom > 0 AS INT)) AS v FROM m WHERE mom IS NOT NULL GROUP BY 1) SELECT session, CASE WHEN v >= 0.6 THEN 'strong' WHEN v >= 0.4 THEN 'mixed' ELSE 'weak' END AS regime FROM b")
def breadth_labels(spark, d):
    b = scored(spark, d).where("mom is not null").groupBy("session").agg(F.avg((F.col("mom") > 0).cast("int")).alias("v"))
    return b.select("session", F.when(F.col("v") >= 0.6, "strong").when(F.col("v") >= 0.4, "mixed").otherwise("weak").alias("regime"))


@query("I27_nested_readings", f"WITH {X}, {SECTORS}, g AS (SELECT sector, count(*) AS n, count(mom) AS held FROM m JOIN sectors USING (ticker) GROUP BY 1) SELECT sector, '{{\"n\":' || n || ',\"held\":' || held || '}}' AS reading FROM g")
def nested_readings(spark, d):
    g = scored(spark, d).join(sectors(spark, d), "ticker").groupBy("sector").agg(F.count("*").alias("n"), F.count("mom").alias("held"))
    return g.select("sector", F.to_json(F.struct("n", "held")).alias("reading"))


@query("J14_maturity", f"WITH {TRADES} SELECT accession, CASE WHEN filed + 60 <= DATE '2001-06-30' THEN 'done' WHEN value IS NULL THEN 'no price' ELSE 'pending' END AS state FROM trades")
def maturity(spark, d):
    return trades(spark, d).select("accession", F.expr("case when date_add(filed, 60) <= date'2001-06-30' then 'done' when value is null then 'no price' else 'pending' end").alias("state"))
