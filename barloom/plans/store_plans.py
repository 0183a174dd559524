"""Queries over stores: merges, retention, ledgers, seams, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import upsert as up
from barloom.plans.catalog import query, r
from barloom.sources.roles import BARS, CALENDAR, SECTORS, bars, calendar, sectors, table

OLD_NEW = f"{BARS}, o AS (SELECT ticker, session, close, 0 AS src FROM bars WHERE session < DATE '2000-01-01'), n AS (SELECT ticker, session, close * 1.01 AS close, 1 AS src FROM bars WHERE session >= DATE '1999-12-01')"


def old_new(spark, d):
    b = bars(spark, d).select("ticker", "session", "close")
    return b.where("session < date'2000-01-01'"), b.where("session >= date'1999-12-01'").withColumn("close", F.col("close") * 1.01)


@query("B1_upsert_keep_last", f"WITH {OLD_NEW}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY src DESC) AS k FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) SELECT ticker, session, round(close, 5) AS close FROM k WHERE k = 1")
def upsert_keep_last(spark, d):
    old, new = old_new(spark, d)
    return up.keep_last(old, new, ["ticker", "session"]).select("ticker", "session", r("close", "close", 5))


@query("B2_delete_before", f"WITH {BARS}, g AS (SELECT s_suppkey AS ticker, DATE '1998-01-01' AS before FROM supplier WHERE s_suppkey % 9 = 0) SELECT ticker, session, round(close, 5) AS close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ticker = b.ticker AND b.session < g.before)")
def delete_before(spark, d):
    gone = table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("ticker"), F.lit("1998-01-01").cast("date").alias("before"))
    return up.delete_rows(bars(spark, d), gone, ["ticker"], "before").select("ticker", "session", r("close", "close", 5))


@query("B4_retention", f"WITH {BARS} SELECT ticker, count(*) AS n FROM bars WHERE session >= DATE '2001-10-01' - 365 GROUP BY 1")
def retention(spark, d):
    return up.retain(bars(spark, d), "session", "2001-10-01", 365).groupBy("ticker").agg(F.count("*").alias("n"))


@query("B7_replace_sessions", f"WITH {OLD_NEW} SELECT session, count(*) AS n, round(sum(close), 2) AS total FROM (SELECT * FROM o WHERE session NOT IN (SELECT session FROM n) UNION ALL SELECT * FROM n) GROUP BY 1")
def replace_sessions(spark, d):
    old, new = old_new(spark, d)
    return up.replace_groups(old, new, ["session"]).groupBy("session").agg(F.count("*").alias("n"), r(F.sum("close"), "total", 2))


@query("B18_reconcile", "WITH r AS (SELECT s_suppkey AS k, DATE '2020-01-01' AS seen FROM supplier WHERE s_suppkey % 4 <> 0), t AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0) SELECT coalesce(r.k, t.k) AS ticker, CASE WHEN r.k IS NULL THEN 'added' WHEN t.k IS NULL THEN 'removed' ELSE 'active' END AS status, CASE WHEN t.k IS NOT NULL THEN DATE '2024-01-01' ELSE seen END AS last_seen FROM r FULL JOIN t ON r.k = t.k")
def reconcile(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"))
    registry = s.where("ticker % 4 <> 0").withColumn("last_seen", F.lit("2020-01-01").cast("date"))
    return up.reconcile(registry, s.where("ticker % 5 <> 0"), "ticker", "2024-01-01")


@query("H4_missing_sessions", f"WITH {BARS}, {CALENDAR}, {SECTORS} SELECT sector, session FROM (SELECT sector, session FROM cal, (SELECT DISTINCT sector FROM sectors)) ANTI JOIN (SELECT sector, session FROM bars JOIN sectors USING (ticker)) USING (sector, session)")
def missing_sessions(spark, d):
    """Sessions that the store of a sector lacks."""
    held = bars(spark, d).join(sectors(spark, d), "ticker").select("sector", "session").distinct()
    wanted = calendar(spark, d).select("session").crossJoin(F.broadcast(sectors(spark, d).select("sector").distinct()))  # a few sectors
    return wanted.join(held, ["sector", "session"], "left_anti").select("sector", "session")


@query("H4_missing_by_ticker", f"WITH {BARS}, {CALENDAR}, s AS (SELECT ticker, min(session) AS a, max(session) AS z FROM bars GROUP BY 1) SELECT s.ticker, c.session FROM s JOIN cal c ON c.session BETWEEN s.a AND s.z ANTI JOIN bars b ON b.ticker = s.ticker AND b.session = c.session")
def missing_by_ticker(spark, d):
    """Sessions between a name's first and last bar for which it has none, of all names."""
    return up.missing_sessions_by(calendar(spark, d), bars(spark, d), "ticker")


@query("J13_insert_only", "WITH l AS (SELECT o_orderkey AS k, 'old' AS src FROM orders WHERE o_orderkey % 2 = 0) SELECT k, src FROM l UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey NOT IN (SELECT k FROM l)")
def insert_only(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return up.insert_only(o.where("k % 2 = 0").withColumn("src", F.lit("old")), o.withColumn("src", F.lit("new")), ["k"])


@query("B24_failed_registry", "WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1) SELECT user_id, fails, CASE WHEN fails >= 15 THEN 'dead' WHEN fails > 0 THEN 'failing' ELSE 'alive' END AS state FROM f")
def failed_registry(spark, d):
    f = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fails"))
    return f.withColumn("state", F.when(F.col("fails") >= 15, "dead").when(F.col("fails") > 0, "failing").otherwise("alive"))


@query("A13_sessions_index", "SELECT DISTINCT CAST(ts AS DATE) AS session, event_type AS module FROM events")
def sessions_index(spark, d):
    return table(spark, d, "events").select(F.to_date("ts").alias("session"), F.col("event_type").alias("module")).distinct()


@query("A19_latest_filing_wins", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey FROM k WHERE n = 1")
def latest_filing_wins(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("D14_source_dedup", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def source_dedup(spark, d):
    held = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(held, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("D27_sector_map", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'tech' WHEN p_size BETWEEN 11 AND 20 THEN 'energy' WHEN p_size BETWEEN 21 AND 35 THEN 'health' ELSE 'other' END AS sector FROM part")
def sector_map(spark, d):
    from barloom.operators.mapping import by_ranges

    return table(spark, d, "part").select("p_partkey", by_ranges(F.col("p_size"), [(1, 10, "tech"), (11, 20, "energy"), (21, 35, "health")], "other").alias("sector"))


@query("D29_group_override", "SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 11 = 0 THEN 'OVERRIDE' ELSE r_name END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def group_override(spark, d):
    s = sectors(spark, d)
    override = s.where("ticker % 11 = 0").select("ticker", F.lit("OVERRIDE").alias("own"))
    return s.join(override, "ticker", "left").select("ticker", F.coalesce("own", "sector").alias("sector"))


@query("D38_unique_first_word", "WITH w AS (SELECT c_custkey, split_part(replace(lower(c_name), '#000000', ' '), ' ', 2) AS word FROM customer) SELECT right(word, 3) AS word, min(c_custkey) AS c_custkey FROM w GROUP BY 1 HAVING count(*) = 1")
def unique_first_word(spark, d):
    """Words that one name alone has: they tell the company."""
    w = table(spark, d, "customer").select("c_custkey", F.right(F.split_part(F.replace(F.lower("c_name"), F.lit("#000000"), F.lit(" ")), F.lit(" "), F.lit(2)), F.lit(3)).alias("word"))
    return w.groupBy("word").agg(F.min("c_custkey").alias("c_custkey"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("C6_universe_funnel", "SELECT count(*) AS listed, CAST(sum(CAST(s_acctbal > 0 AS INT)) AS BIGINT) AS solvent, CAST(sum(CAST(s_acctbal > 0 AND s_nationkey < 15 AS INT)) AS BIGINT) AS domestic, CAST(sum(CAST(s_acctbal > 0 AND s_nationkey < 15 AND NOT regexp_matches(s_name, '7$') AS INT)) AS BIGINT) AS kept FROM supplier")
def universe_funnel(spark, d):
    from barloom.operators.mapping import funnel

    return funnel(table(spark, d, "supplier"), [("listed", "true"), ("solvent", "s_acctbal > 0"), ("domestic", "s_nationkey < 15"), ("kept", "not rlike(s_name, '7$')")])


@query("E141_sanity_counts", "SELECT count(*) FILTER (l_shipdate < o_orderdate) AS early, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 30 DAY) AS late, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def sanity_counts(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 30 days")).alias("late"), F.count("*").alias("n"))


@query("C23_sanity_bounds", "SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 100 AND 1500 THEN round(p_retailprice, 4) END AS price, CASE WHEN p_size BETWEEN 5 AND 45 THEN p_size END AS size FROM part")
def sanity_bounds(spark, d):
    from barloom.operators.mapping import bounded

    out = bounded(table(spark, d, "part"), {"p_retailprice": (100, 1500), "p_size": (5, 45)})
    return out.select("p_partkey", r("p_retailprice", "price", 4), F.col("p_size").alias("size"))


@query("D32_compare_sources", "WITH j AS (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_retailprice * 1.2 ELSE p_retailprice END AS b FROM part) SELECT CASE WHEN b IS NULL THEN 'missing' WHEN abs(a - b) / abs(b) <= 0.05 THEN 'ok' ELSE 'differs' END AS status, count(*) AS n FROM j GROUP BY 1")
def compare_sources(spark, d):
    from barloom.operators.mapping import compare

    j = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.expr("case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then p_retailprice * 1.2 else p_retailprice end").alias("b"))
    return j.groupBy(compare(F.col("a"), F.col("b"), 0.05).alias("status")).agg(F.count("*").alias("n"))


@query("H2_union_rejects", "SELECT p_partkey, 'SIZE' AS reason, p_size AS size, CAST(NULL AS DOUBLE) AS price FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'PRICE', NULL, round(p_retailprice, 4) FROM part WHERE p_retailprice > 1800")
def union_rejects(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size > 45").select("p_partkey", F.lit("SIZE").alias("reason"), F.col("p_size").alias("size"))
    return a.unionByName(p.where("p_retailprice > 1800").select("p_partkey", F.lit("PRICE").alias("reason"), r("p_retailprice", "price", 4)), allowMissingColumns=True)


@query("G1_report_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders")
def report_order(spark, d):
    bucket = F.expr("case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end")
    w = Window.partitionBy("o_orderpriority").orderBy(bucket, F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("J12_setup_registry")
def setup_registry(spark, d):
    from barloom.streaming.registry import fold_setups

    b = bars(spark, d).withColumn("peak_idx", F.floor(F.datediff("session", F.lit("1995-01-01")) / 10).cast("long"))
    seen = b.where("trades >= 2").select("ticker", F.datediff("session", F.lit("1995-01-01")).cast("long").alias("day"), "peak_idx")
    return fold_setups(seen)
