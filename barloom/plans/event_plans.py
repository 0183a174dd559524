"""Queries over filings, trades and event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio
from barloom.operators import asof
from barloom.operators import events as ev
from barloom.operators import windows as w
from barloom.plans.catalog import query, r
from barloom.sources.roles import BARS, CALENDAR, bars, calendar, table

T = "PARTITION BY ticker ORDER BY session"
#: Insider trades: orders as filings of a customer (owner) at an issuer.
TRADES = """trades AS (SELECT o_custkey AS owner, o_orderkey % 50 AS issuer, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS value, o_orderkey AS accession, o_orderpriority AS role FROM orders)"""


def trades(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.pmod("o_orderkey", F.lit(50)).alias("issuer"), F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("role"))


def kind(spark, d, name):
    return table(spark, d, "events").where(F.col("event_type") == name)


@query("D1_asof_view_purchase", "SELECT p.event_id, v.event_id AS view_id, round(v.value, 6) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts")
def view_before_purchase(spark, d):
    views = kind(spark, d, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = asof.backward(kind(spark, d, "purchase"), views, "user_id", "ts", "view_ts", ["view_id", "view_value"])
    return out.select("event_id", "view_id", r("view_value", "view_value"))


@query("D3_asof_tolerance", "SELECT p.event_id, CASE WHEN CAST(v.ts AS DATE) >= CAST(p.ts AS DATE) - 2 THEN v.event_id END AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts < p.ts")
def view_within_two_days(spark, d):
    views = kind(spark, d, "view").select("user_id", F.to_timestamp("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    left = kind(spark, d, "purchase")
    held = asof.backward(left, views.withColumn("day", F.to_date("view_ts")), "user_id", "ts", "view_ts", ["view_id", "day"], strict=True)
    return held.select("event_id", F.when(F.col("day") >= F.date_sub(F.to_date("ts"), 2), F.col("view_id")).alias("view_id"))


@query("D7_next_session", f"WITH {CALENDAR}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o.day, (SELECT min(session) FROM cal WHERE session > o.day) AS next_session FROM o")
def next_session(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return asof.next_session(days, calendar(spark, d), "day", "next_session")


@query("D8_public_session", f"WITH {CALENDAR}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o.day, (SELECT min(session) FROM cal WHERE session >= o.day) AS public_session FROM o")
def public_session(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return asof.next_session(days, calendar(spark, d), "day", "public_session", at_or_after=True)


@query("D18_peer_price", f"""WITH {TRADES} SELECT a.accession, count(b.accession) AS n_peers, round(CASE WHEN count(b.accession) >= 2 THEN quantile_cont(b.value, 0.5) END, 4) AS peer_median FROM trades a LEFT JOIN trades b ON a.issuer = b.issuer AND b.owner <> a.owner AND b.filed BETWEEN a.filed - 15 AND a.filed + 15 GROUP BY 1""")
def peer_price(spark, d):
    return asof.neighbours_within(trades(spark, d).drop("role"), "issuer", "filed", 15, "value", "owner").select("accession", "n_peers", r("peer_median", "peer_median", 4))


@query("D19_nearest_within_day", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT * FROM events WHERE event_type = 'click'), j AS (SELECT e.event_id, c.event_id AS click_id, abs(epoch(e.ts) - epoch(c.ts)) AS lag, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch(e.ts) - epoch(c.ts)), c.event_id) AS n FROM e JOIN c USING (user_id) WHERE abs(epoch(e.ts) - epoch(c.ts)) <= 86400)
SELECT event_id, click_id, round(lag, 3) AS lag FROM j WHERE n = 1""")
def nearest_click(spark, d):
    """A band join through day buckets: rows meet only within a day of each other."""
    clock = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = kind(spark, d, "error").select("event_id", "user_id", "ts", F.explode(F.array(*[F.date_add(F.to_date("ts"), i) for i in (-1, 0, 1)])).alias("day"))
    c = kind(spark, d, "click").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("cts"), F.to_date("ts").alias("day"))
    j = e.join(c, ["user_id", "day"]).withColumn("lag", F.abs(clock("ts") - clock("cts"))).where("lag <= 86400")
    return asof.latest_by(j, ["event_id"], [F.asc("lag"), F.asc("click_id")]).select("event_id", "click_id", r("lag", "lag", 3))


@query("D17_annual_quarters", f"WITH {TRADES}, y AS (SELECT DISTINCT issuer, make_date(CAST(year(filed) AS INT), 12, 31) AS fy FROM trades) SELECT y.issuer, y.fy, count(*) AS n, round(sum(value), 4) AS value FROM y JOIN trades t ON t.issuer = y.issuer AND t.filed > y.fy - INTERVAL 12 MONTH AND t.filed <= y.fy GROUP BY 1, 2")
def annual_quarters(spark, d):
    t = trades(spark, d)
    y = t.select("issuer", F.expr("make_date(year(filed), 12, 31)").alias("fy")).distinct()
    return y.join(t, "issuer").where("filed > add_months(fy, -12) and filed <= fy").groupBy("issuer", "fy").agg(F.count("*").alias("n"), r(F.sum("value"), "value", 4))


@query("E50_owner_filings", f"""WITH {TRADES}, d AS (SELECT owner, issuer, filed, sum(value) AS value, count(*) AS lines FROM trades GROUP BY 1, 2, 3) SELECT owner, issuer, filed, round(value, 4) AS value, lines, CAST(filed - lag(filed) OVER o AS INT) AS since, (lag(filed) OVER o IS NULL OR filed - lag(filed) OVER o >= 730) AS rare FROM d WINDOW o AS (PARTITION BY owner, issuer ORDER BY filed)""")
def owner_filings(spark, d):
    return ev.owner_filings(trades(spark, d)).select("owner", "issuer", "filed", r("value", "value", 4), "lines", "since", "rare")


@query("E50_routine", f"""WITH {TRADES}, m AS (SELECT DISTINCT owner, year(filed) AS y, month(filed) AS m FROM trades) SELECT accession, (SELECT count(*) FROM m WHERE m.owner = t.owner AND m.m = month(t.filed) AND m.y BETWEEN year(t.filed) - 3 AND year(t.filed) - 1) = 3 AS routine FROM trades t""")
def routine(spark, d):
    return ev.routine(trades(spark, d)).select("accession", "routine")


@query("E52_month_window", f"""WITH {TRADES}, d AS (SELECT DISTINCT issuer, filed AS day FROM trades) SELECT d.issuer, d.day, count(DISTINCT t.owner) AS names, round(sum(t.value), 4) AS value FROM d JOIN trades t ON t.issuer = d.issuer AND t.filed > d.day - 30 AND t.filed <= d.day GROUP BY 1, 2""")
def month_window(spark, d):
    return ev.trailing_window(trades(spark, d), "issuer", "filed", 30, "owner", "value").select("issuer", "day", "names", r("value", "value", 4))


@query("E51_track_record", f"""WITH {TRADES}, x AS (SELECT *, filed + 60 AS done, value / 1000 AS ex FROM trades) SELECT a.accession, count(b.accession) AS past_n, round(CASE WHEN count(b.accession) >= 2 THEN avg(b.ex) END, 5) AS past_mean FROM x a LEFT JOIN x b ON b.owner = a.owner AND b.done < a.filed GROUP BY 1""")
def track_record(spark, d):
    x = trades(spark, d).withColumn("done", F.date_add("filed", 60)).withColumn("ex", F.col("value") / 1000)
    return ev.track_record(x, "owner", "filed", "done", "ex").select("accession", "past_n", r("past_mean", "past_mean", 5))


@query("C10_purchase_filter", f"WITH {TRADES} SELECT accession, owner, round(value, 4) AS value FROM trades WHERE role IN ('1-URGENT', '2-HIGH') AND value > 100000")
def purchase_filter(spark, d):
    """Large purchases of all owners; C10_purchase_owners leaves entities out."""
    return trades(spark, d).where("role in ('1-URGENT', '2-HIGH') and value > 100000").select("accession", "owner", r("value", "value", 4))


@query("C10_purchase_owners", f"WITH {TRADES} SELECT accession, owner, round(value, 4) AS value FROM trades LEFT JOIN customer ON c_custkey = owner WHERE role IN ('1-URGENT', '2-HIGH') AND value > 100000 AND c_mktsegment IS DISTINCT FROM 'MACHINERY'")
def purchase_owners(spark, d):
    """Purchases of all owners but those of one segment, which stands for entities; an owner of no known segment stays."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_mktsegment")
    kept = trades(spark, d).where("role in ('1-URGENT', '2-HIGH') and value > 100000").join(owners, "owner", "left")
    return kept.where("not (c_mktsegment <=> 'MACHINERY')").select("accession", "owner", r("value", "value", 4))


@query("I11_role", "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '(?i)urgent') THEN 'CEO' WHEN regexp_matches(o_orderpriority, '(?i)high|medium') THEN 'OFFICER' WHEN regexp_matches(o_orderpriority, '(?i)low') THEN 'DIRECTOR' ELSE 'OTHER' END AS role FROM orders")
def role(spark, d):
    from barloom.functions.text import first_match

    return table(spark, d, "orders").select("o_orderkey", first_match("o_orderpriority", [("CEO", "urgent"), ("OFFICER", "high|medium"), ("DIRECTOR", "low")], "OTHER").alias("role"))


STUDY = f"""{BARS}, {TRADES}, f AS (SELECT ticker, session, lead(close, 5) OVER ({T}) / lead(open) OVER ({T}) - 1 AS fwd FROM bars), p AS (SELECT ticker, session, fwd, avg(fwd) OVER (PARTITION BY session) AS pool FROM f), e AS (SELECT DISTINCT issuer + 1 AS ticker, filed AS session FROM trades WHERE value > 200000), j AS (SELECT p.* , (fwd - pool) * 100 AS x FROM p JOIN e USING (ticker, session) WHERE fwd IS NOT NULL)"""


def event_rows(spark, d):
    p = bars(spark, d).select("ticker", "session", w.forward_return(5).alias("fwd")).withColumn("pool", F.avg("fwd").over(Window.partitionBy("session")))
    e = trades(spark, d).where("value > 200000").select((F.col("issuer") + 1).alias("ticker"), F.col("filed").alias("session")).distinct()
    return p.join(e, ["ticker", "session"])


@query("E57_event_study", f"""WITH {STUDY}, q AS (SELECT date_trunc('quarter', session) AS q, avg(x) AS m FROM j GROUP BY 1), t AS (SELECT avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t, count(*) AS quarters FROM q)
SELECT count(*) AS n, round(avg(x), 5) AS mean, round(quantile_cont(x, 0.5), 5) AS median, round(avg(CAST(fwd > 0 AS INT)), 6) AS up, round(avg(CAST(x > 0 AS INT)), 6) AS beat, round(any_value(t), 4) AS t, any_value(quarters) AS quarters FROM j, t HAVING count(*) >= 10""")
def event_study(spark, d):
    s = ev.study(event_rows(spark, d), "fwd", "pool", "session")
    return s.select("n", r("mean", "mean", 5), r("median", "median", 5), r("up", "up"), r("beat", "beat"), r("t", "t", 4), "quarters")


@query("E23_halves_verdict", f"""WITH {STUDY}, g AS (SELECT *, ticker % 3 AS g FROM j), m AS (SELECT g, quantile_cont(session - DATE '1970-01-01', 0.5) AS mid FROM g WHERE session < DATE '1999-01-01' GROUP BY 1),
a AS (SELECT g, avg(x) FILTER (session - DATE '1970-01-01' <= mid) AS h1, avg(x) FILTER (session - DATE '1970-01-01' > mid) AS h2, avg(x) AS train FROM g JOIN m USING (g) WHERE session < DATE '1999-01-01' GROUP BY 1),
b AS (SELECT g, avg(x) AS test, CASE WHEN count(x) >= 3 THEN avg(x) / (stddev_samp(x) / sqrt(count(x))) END AS t FROM g WHERE session >= DATE '1999-01-01' GROUP BY 1)
SELECT g, round(h1, 5) AS h1, round(h2, 5) AS h2, round(test, 5) AS test, round(t, 4) AS t_test, coalesce(sign(h1) = sign(h2) AND sign(h1) = sign(test) AND abs(t) >= 2, false) AS kept FROM a JOIN b USING (g)""")
def halves_verdict(spark, d):
    g = event_rows(spark, d).where("fwd is not null").withColumn("x", (F.col("fwd") - F.col("pool")) * 100).withColumn("g", F.pmod("ticker", F.lit(3)))
    out = ev.halves_verdict(g, "x", "session", "1999-01-01", ["g"])
    return out.select("g", r("h1", "h1", 5), r("h2", "h2", 5), r("test", "test", 5), r("t_test", "t_test", 4), "kept")


@query("F48_episodes", f"""WITH RECURSIVE {BARS}, k AS (SELECT ticker, session, row_number() OVER ({T}) AS bar, close / lag(close) OVER ({T}) - 1 AS v FROM bars), e AS (SELECT ticker, session, bar FROM k WHERE v > 0.3),
t AS (SELECT ticker, min(bar) AS bar FROM e GROUP BY 1 UNION ALL SELECT t.ticker, (SELECT min(e.bar) FROM e WHERE e.ticker = t.ticker AND e.bar >= t.bar + 21) FROM t WHERE t.bar IS NOT NULL) SELECT e.ticker, e.session FROM t JOIN e USING (ticker, bar)""")
def episodes(spark, d):
    k = bars(spark, d).select("ticker", "session", F.row_number().over(w.order()).alias("bar"), (ratio(F.col("close"), F.lag("close").over(w.order())) - 1).alias("v")).where("v > 0.3").drop("v")
    return ev.thin_episodes(k, 21).select("ticker", "session")


@query("D21_random_controls", f"""WITH {BARS}, {TRADES}, e AS (SELECT DISTINCT issuer + 1 AS ticker, filed AS session FROM trades WHERE value > 200000), k AS (SELECT session, count(*) AS k FROM bars JOIN e USING (ticker, session) GROUP BY 1), o AS (SELECT ticker, session, row_number() OVER (PARTITION BY session ORDER BY md5('7|' || session || '|' || ticker), ticker) AS n FROM bars)
SELECT ticker, session FROM o JOIN k USING (session) WHERE n <= k""")
def random_controls(spark, d):
    b = bars(spark, d).select("ticker", "session")
    wanted = event_rows(spark, d).groupBy("session").agg(F.count("*").alias("k"))
    return ev.random_controls(b, wanted, "session", 7)


@query("J6_first_of_key", "SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def first_of_key(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    return asof.latest_by(e, ["user_id", "day", "event_type"], [F.asc("event_id")])


@query("I26_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("K6_decay_mean", "WITH m AS (SELECT max(CAST(ts AS DATE)) AS m FROM events) SELECT user_id, round(sum(value * pow(0.5, (m - CAST(ts AS DATE)) / 5.0)) / sum(pow(0.5, (m - CAST(ts AS DATE)) / 5.0)), 6) AS mean FROM events, m WHERE value IS NOT NULL GROUP BY 1")
def decay_mean(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("day", F.to_date("ts"))
    e = e.join(F.broadcast(e.agg(F.max("day").alias("m"))), how="cross")  # one row
    weight = F.pow(F.lit(0.5), F.datediff("m", "day") / 5.0)
    return e.groupBy("user_id").agg(r(ratio(F.sum(F.col("value") * weight), F.sum(weight)), "mean"))


@query("E80_news_windows", "WITH m AS (SELECT max(CAST(ts AS DATE)) AS m FROM events) SELECT user_id, count(*) FILTER (m - CAST(ts AS DATE) < 5) AS n5, count(*) AS n30, round(avg(value) FILTER (m - CAST(ts AS DATE) < 5), 6) AS mean5, round(avg(value), 6) AS mean30, max(CAST(ts AS DATE)) AS newest, arg_max(event_id, value) AS top FROM events, m GROUP BY 1")
def news_windows(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    e = e.join(F.broadcast(e.agg(F.max("day").alias("m"))), how="cross")  # one row
    near = F.datediff("m", "day") < 5
    there = F.col("value").isNotNull() & F.col("event_id").isNotNull()
    best = F.when(there, F.struct("value", F.bitwise_not("event_id")))  # of equal values the first event's
    return e.groupBy("user_id").agg(F.count_if(near).alias("n5"), F.count("*").alias("n30"), r(F.avg(F.when(near, F.col("value"))), "mean5"), r(F.avg("value"), "mean30"), F.max("day").alias("newest"), F.max_by("event_id", best).alias("top"))
