"""Queries over stores, registries, mappings, company facts and studies that recombine them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import clip, correlation, rank_avg, rank_pct, ratio
from barloom.operators import accounting as ac
from barloom.operators import asof
from barloom.operators import upsert as up
from barloom.operators import windows as w
from barloom.plans.catalog import query, r
from barloom.sources.roles import BARS, CALENDAR, FACTS, SECTORS, bars, calendar, dealt, facts, parts, sectors, table

T = "PARTITION BY ticker ORDER BY session"
C = F.col


# ---- scans and stores


@query("A2_stored_dates", f"WITH {BARS} SELECT DISTINCT session FROM bars")
def stored_dates(spark, d):
    return bars(spark, d).select("session").distinct()


@query("A17_quarter_listing", f"WITH {FACTS} SELECT CAST(year(ddate) AS INT) AS y, CAST(quarter(ddate) AS INT) AS q, count(*) AS n FROM facts GROUP BY 1, 2")
def quarter_listing(spark, d):
    return facts(spark, d).groupBy(F.year("ddate").alias("y"), F.quarter("ddate").alias("q")).agg(F.count("*").alias("n"))


@query("A18_insider_scan", f"WITH {FACTS}, b AS (SELECT * FROM facts WHERE form = 'F'), e AS (SELECT * FROM facts WHERE form <> 'P') SELECT adsh, cik, filed, form, round(value, 2) AS value FROM b UNION ALL SELECT adsh, cik, filed, form, round(value, 2) FROM e WHERE adsh NOT IN (SELECT adsh FROM b)")
def insider_scan(spark, d):
    """Two stores of filings: the bulk copy of an accession beats the other."""
    f = facts(spark, d).select("adsh", "cik", "filed", "form", r("value", "value", 2))
    bulk = f.where("form = 'F'")
    return bulk.unionByName(f.where("form <> 'P'").join(bulk, "adsh", "left_anti"))


@query("A21_event_scan", "SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'deal' WHEN 'click' THEN 'interest' WHEN 'error' THEN 'trouble' ELSE 'other' END AS event_class FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def event_scan(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("purchase", "deal", "click", "interest", "error", "trouble")])
    e = table(spark, d, "events").where("ts >= timestamp'2024-01-02' and ts < timestamp'2024-01-20'")
    return e.select("event_id", "user_id", F.coalesce(F.try_element_at(names, C("event_type")), F.lit("other")).alias("event_class"))


@query("A22_etf_bars", f"WITH {BARS}, {SECTORS} SELECT subind, session, round(sum(close * volume) / sum(volume), 5) AS close FROM bars JOIN sectors USING (ticker) WHERE session BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")
def etf_bars(spark, d):
    """One fund a group: the volume-weighted close of its names."""
    b = bars(spark, d).where("session between date'1997-01-01' and date'1998-12-31'").join(sectors(spark, d), "ticker")
    return b.groupBy("subind", "session").agg(r(ratio(F.sum(C("close") * C("volume")), F.sum("volume")), "close", 5))


@query("A23_sentiment_cache", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def sentiment_cache(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("A45_session_closes", f"WITH {CALENDAR} SELECT session, CASE WHEN month(session) = 12 AND day(session) = 24 THEN 13 WHEN month(session) = 7 AND day(session) = 3 THEN 13 ELSE 16 END AS close_hour FROM cal")
def session_closes(spark, d):
    early = ((F.month("session") == 12) & (F.day("session") == 24)) | ((F.month("session") == 7) & (F.day("session") == 3))
    return calendar(spark, d).select("session", F.when(early, 13).otherwise(16).alias("close_hour"))


@query("A48_backfill_targets", f"WITH {FACTS}, l AS (SELECT cik, max(ddate) AS last FROM facts GROUP BY 1), m AS (SELECT max(ddate) AS m FROM facts) SELECT c_custkey AS cik, CASE WHEN last IS NULL THEN 'gap' ELSE 'stale' END AS reason FROM customer LEFT JOIN l ON cik = c_custkey, m WHERE last IS NULL OR last < m - 150")
def backfill_targets(spark, d):
    """Companies without facts, and those whose newest period is 150 days old."""
    f = facts(spark, d)
    last = f.groupBy("cik").agg(F.max("ddate").alias("last"))
    newest = f.agg(F.max("ddate").alias("m"))  # one row
    j = table(spark, d, "customer").select(C("c_custkey").alias("cik")).join(last, "cik", "left").crossJoin(F.broadcast(newest))
    return j.where(C("last").isNull() | (C("last") < F.date_sub("m", 150))).select("cik", F.when(C("last").isNull(), "gap").otherwise("stale").alias("reason"))


Q = "p AS (SELECT cik, concept, ddate, max(value) AS v FROM facts WHERE form = 'F' GROUP BY 1, 2, 3), s AS (SELECT cik, concept, ddate, max(value) AS v FROM facts WHERE form = 'O' GROUP BY 1, 2, 3)"


@query("A49_provider_quarters", f"WITH {FACTS}, {Q} SELECT cik, concept, ddate, round(coalesce(p.v, s.v), 2) AS v, p.v IS NULL AS filled FROM p FULL JOIN s USING (cik, concept, ddate)")
def provider_quarters(spark, d):
    """A provider's cells fill only what the filings leave empty."""
    f, k = facts(spark, d), ["cik", "concept", "ddate"]
    side = lambda form, name: f.where(C("form") == form).groupBy(*k).agg(F.max("value").alias(name))
    return side("F", "a").join(side("O", "b"), k, "full_outer").select(*k, r(F.coalesce("a", "b"), "v", 2), C("a").isNull().alias("filled"))


@query("A50_sector_map", f"WITH {FACTS}, n AS (SELECT cik, concept, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, adsh DESC) AS k FROM facts) SELECT c_custkey AS cik, CASE concept WHEN '1-URGENT' THEN 'Technology' WHEN '2-HIGH' THEN 'Health' WHEN '3-MEDIUM' THEN 'Energy' ELSE 'Other' END AS sector FROM customer LEFT JOIN n ON cik = c_custkey AND k = 1")
def sector_map(spark, d):
    newest = facts(spark, d).groupBy("cik").agg(F.max_by("concept", F.struct("filed", "adsh")).alias("code"))
    sector = F.when(C("code") == "1-URGENT", "Technology").when(C("code") == "2-HIGH", "Health").when(C("code") == "3-MEDIUM", "Energy").otherwise("Other")
    return table(spark, d, "customer").select(C("c_custkey").alias("cik")).join(newest, "cik", "left").select("cik", sector.alias("sector"))


@query("A51_coverage_report", f"WITH {BARS}, n AS (SELECT s_suppkey, count(session) AS n FROM supplier LEFT JOIN bars ON ticker = s_suppkey GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'none' WHEN n < 500 THEN 'short' ELSE 'full' END AS reason, count(*) AS names FROM n GROUP BY 1")
def coverage_report(spark, d):
    n = table(spark, d, "supplier").join(bars(spark, d).groupBy(C("ticker").alias("s_suppkey")).agg(F.count("*").alias("n")), "s_suppkey", "left")
    return n.groupBy(F.when(C("n").isNull(), "none").when(C("n") < 500, "short").otherwise("full").alias("reason")).agg(F.count("*").alias("names"))


@query("B5_dated_retention", f"WITH {CALENDAR}, m AS (SELECT max(session) AS m FROM cal) SELECT session FROM cal, m WHERE session >= m - 400")
def dated_retention(spark, d):
    """Dated files younger than 400 days stay."""
    c = calendar(spark, d).select("session")
    return up.retain(c.crossJoin(F.broadcast(c.agg(F.max("session").alias("m")))), "session", "1900-01-01", 0).where(C("session") >= F.date_sub("m", 400)).select("session")


@query("B13_accession_upsert", f"WITH {FACTS}, n AS (SELECT adsh, cik, value * 2 AS value FROM facts WHERE filed >= DATE '1998-01-01') SELECT adsh, cik, round(value, 2) AS value FROM n UNION ALL SELECT adsh, cik, round(value, 2) FROM facts WHERE adsh NOT IN (SELECT adsh FROM n)")
def accession_upsert(spark, d):
    """Every row of a refiled accession comes from the new batch."""
    f = facts(spark, d).select("adsh", "cik", "value", "filed")
    new = f.where("filed >= date'1998-01-01'").select("adsh", "cik", (C("value") * 2).alias("value"))
    return up.replace_groups(f.drop("filed"), new, ["adsh"]).select("adsh", "cik", r("value", "value", 2))


@query("B16_trade_merge", "WITH a AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, day, event_id FROM a")
def trade_merge(spark, d):
    """Reports that tell the same trade again: the last one stays."""
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return asof.latest_by(e, ["user_id", "event_type", "day"], [F.desc("event_id")]).select("user_id", "event_type", "day", "event_id")


@query("B17_provider_merge", "SELECT k, src FROM (SELECT c_custkey AS k, 'new' AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_acctbal <= 0)")
def provider_merge(spark, d):
    c = table(spark, d, "customer")
    old = c.select(C("c_custkey").alias("k"), F.lit("old").alias("src"))
    return up.keep_last(old, c.where("c_acctbal > 0").select(C("c_custkey").alias("k"), F.lit("new").alias("src")), ["k"])


@query("B20_screen_output", f"WITH {BARS}, n AS (SELECT ticker, max(session) AS day, count(*) AS n, count(*) FILTER (volume > 30) AS busy FROM bars GROUP BY 1) SELECT ticker, day, ('[' || concat_ws(', ', CASE WHEN n < 520 THEN 'SHORT' END, CASE WHEN busy < 100 THEN 'QUIET' END) || ']') AS failed FROM n")
def screen_output(spark, d):
    """Flags and rejects of a date with all gates that fail; lists stay lists in the store and are text only here."""
    n = bars(spark, d).groupBy("ticker").agg(F.max("session").alias("day"), F.count("*").alias("n"), F.count_if(C("volume") > 30).alias("busy"))
    failed = F.array_compact(F.array(F.when(C("n") < 520, "SHORT"), F.when(C("busy") < 100, "QUIET")))
    return n.select("ticker", "day", F.concat(F.lit("["), F.array_join(failed, ", "), F.lit("]")).alias("failed"))


# ---- filters, mappings and joins


@query("C8_name_kill", "SELECT s_suppkey, regexp_matches(s_name, '(?i)(warrant|unit|right)s?|[#]0+[0-9]*9$') OR (regexp_matches(s_name, '7$') AND s_acctbal < 0) AS dropped FROM supplier")
def name_kill(spark, d):
    """Names of what is no common share; the weaker mark counts only where a second source confirms it."""
    name = C("s_name")
    return table(spark, d, "supplier").select("s_suppkey", (name.rlike("(?i)(warrant|unit|right)s?|[#]0+[0-9]*9$") | (name.rlike("7$") & (C("s_acctbal") < 0))).alias("dropped"))


@query("C13_event_window", f"WITH {FACTS} SELECT adsh, cik, filed FROM facts WHERE filed > DATE '1998-06-30' - 30 AND filed <= DATE '1998-06-30'")
def event_window(spark, d):
    day = F.lit("1998-06-30").cast("date")
    return facts(spark, d).where((C("filed") > F.date_sub(day, 30)) & (C("filed") <= day)).select("adsh", "cik", "filed")


@query("C14_house_buys", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value >= 50 AND CAST(ts AS DATE) > DATE '2024-01-05' AND CAST(ts AS DATE) <= DATE '2024-01-25'")
def house_buys(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").where((C("event_type") == "purchase") & (C("value") >= 50) & (day > "2024-01-05") & (day <= "2024-01-25")).select("event_id", "user_id")


@query("C22_display_projection", "SELECT p_partkey, round(p_retailprice / 7, 4) AS price, round(CASE WHEN p_size = 0 THEN NULL ELSE ln(p_size) END, 4) AS size FROM part")
def display_projection(spark, d):
    shown = lambda x, name: r(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), name, 4)
    return table(spark, d, "part").select("p_partkey", shown(C("p_retailprice") / 7, "price"), shown(F.ln(F.nullif(C("p_size"), F.lit(0)).cast("double")), "size"))


@query("C24_provider_derive", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal END, 8) AS fcf_yield, round(CASE WHEN c_acctbal > 0 THEN greatest(-10.0, least(10.0, (500 - c_nationkey * 40) / c_acctbal)) END, 6) AS net_debt_ebitda FROM customer")
def provider_derive(spark, d):
    b = C("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", r(F.when(b > 0, ratio(C("c_nationkey"), b)), "fcf_yield", 8), r(F.when(b > 0, clip(ratio(500 - C("c_nationkey") * 40, b), -10.0, 10.0)), "net_debt_ebitda"))


@query("C26_core_codes", "SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 7 OR p_size BETWEEN 20 AND 24 OR p_size = 30 OR p_size BETWEEN 41 AND 43")
def core_codes(spark, d):
    size = C("p_size")
    return table(spark, d, "part").where(size.between(3, 7) | size.between(20, 24) | (size == 30) | size.between(41, 43)).select("p_partkey")


LATEST = "k AS (SELECT ticker, close, volume, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM bars), lt AS (SELECT ticker, close, volume FROM k WHERE k = 1)"


def latest(spark, d):
    b = bars(spark, d)
    return b.groupBy("ticker").agg(F.max_by("close", "session").alias("close"), F.max_by("volume", "session").alias("volume"))


@query("D5_sibling_wide", f"WITH {BARS}, {LATEST} SELECT ticker, round(close, 5) AS price, round(volume, 5) AS size, CAST(NULL AS DOUBLE) AS absent FROM lt")
def sibling_wide(spark, d):
    """All modules' newest values side by side; a metric that no module gives is null."""
    tidy = latest(spark, d).unpivot("ticker", ["close", "volume"], "metric", "value").withColumn("metric", F.when(C("metric") == "close", "price").otherwise("size"))
    wide = tidy.groupBy("ticker").pivot("metric", ["price", "size", "absent"]).agg(F.first("value"))
    return wide.select("ticker", r("price", "price", 5), r("size", "size", 5), C("absent").cast("double").alias("absent"))


@query("D6_explore_collect", f"WITH {BARS}, {LATEST}, {SECTORS} SELECT s.ticker, sector, subind, round(close, 5) AS close, round(avg(close) OVER (PARTITION BY sector), 5) AS sector_close FROM sectors s LEFT JOIN lt ON lt.ticker = s.ticker")
def explore_collect(spark, d):
    j = sectors(spark, d).join(latest(spark, d), "ticker", "left").withColumn("m", F.avg("close").over(Window.partitionBy("sector")))
    return j.select("ticker", "sector", "subind", r("close", "close", 5), r("m", "sector_close", 5))


@query("D12_panel_joins", f"WITH {BARS}, {SECTORS}, f AS (SELECT ticker, session, close, lead(close, 5) OVER ({T}) / close - 1 AS own FROM bars), e AS (SELECT subind, session, avg(own) AS etf FROM f JOIN sectors USING (ticker) GROUP BY 1, 2) SELECT f.ticker, f.session, s.sector, round(own, 6) AS own, round(etf, 6) AS etf FROM f LEFT JOIN sectors s ON s.ticker = f.ticker LEFT JOIN e ON e.subind = s.subind AND e.session = f.session")
def panel_joins(spark, d):
    f = bars(spark, d).select("ticker", "session", (ratio(F.lead("close", 5).over(w.order()), C("close")) - 1).alias("own")).join(sectors(spark, d), "ticker", "left")
    e = f.groupBy("subind", "session").agg(F.avg("own").alias("etf"))
    return f.join(e, ["subind", "session"], "left").select("ticker", "session", "sector", r("own", "own"), r("etf", "etf"))


@query("D15_universe_semi_join", f"WITH {FACTS} SELECT adsh, cik FROM facts WHERE cik IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def universe_semi_join(spark, d):
    u = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0").select(C("c_custkey").alias("cik"))
    return facts(spark, d).join(u, "cik", "left_semi").select("adsh", "cik")


#: Tags of each concept, in order of preference; one tag stands under two concepts.
TAGS = [("Urgent", "1-URGENT"), ("Urgent", "2-HIGH"), ("Normal", "3-MEDIUM"), ("Normal", "4-NOT SPECIFIED"), ("Late", "5-LOW"), ("Late", "2-HIGH")]
TAG_SQL = "tags(concept, tag, place) AS (VALUES " + ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate(TAGS)) + ")"


def tags(spark):
    return spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(TAGS)], "name string, concept string, place int")


@query("D25_shared_concepts", f"WITH {FACTS}, {TAG_SQL} SELECT f.adsh, t.concept FROM facts f JOIN tags t ON f.concept = t.tag")
def shared_concepts(spark, d):
    """A tag that two concepts share gives a row under each."""
    return facts(spark, d).join(tags(spark), "concept").select("adsh", C("name").alias("concept"))


@query("D26_tag_mapping", f"WITH {FACTS}, {TAG_SQL}, m AS (SELECT tag, arg_max(concept, place) AS newest, arg_min(concept, place) AS oldest FROM tags GROUP BY 1) SELECT adsh, newest AS asof_concept, oldest AS history_concept FROM facts JOIN m ON facts.concept = tag")
def tag_mapping(spark, d):
    """The last concept that lists a tag wins as of a day, the first one in histories."""
    m = tags(spark).groupBy("concept").agg(F.max_by("name", "place").alias("asof_concept"), F.min_by("name", "place").alias("history_concept"))
    return facts(spark, d).join(m, "concept").select("adsh", "asof_concept", "history_concept")


@query("D28_subindustry_ranges", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'Small' WHEN p_size BETWEEN 8 AND 24 THEN 'Middle' ELSE 'Other ' || p_type END AS subind FROM part")
def subindustry_ranges(spark, d):
    size = C("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(size.between(1, 9), "Small").when(size.between(8, 24), "Middle").otherwise(F.concat(F.lit("Other "), "p_type")).alias("subind"))


@query("D30_industry_overrides", "WITH m(label, sector) AS (VALUES ('BUILDING', 'Industrials'), ('MACHINERY', 'Industrials'), ('HOUSEHOLD', 'Staples')) SELECT c_custkey, CASE WHEN c_acctbal < 0 AND sector = 'Staples' THEN 'Shell' ELSE coalesce(sector, c_mktsegment) END AS sector FROM customer LEFT JOIN m ON label = c_mktsegment")
def industry_overrides(spark, d):
    m = spark.createDataFrame([("BUILDING", "Industrials"), ("MACHINERY", "Industrials"), ("HOUSEHOLD", "Staples")], "c_mktsegment string, sector string")
    c = table(spark, d, "customer").join(m, "c_mktsegment", "left")
    return c.select("c_custkey", F.when((C("c_acctbal") < 0) & (C("sector") == "Staples"), "Shell").otherwise(F.coalesce("sector", "c_mktsegment")).alias("sector"))


@query("D33_zones_asof", f"WITH {BARS}, m AS (SELECT ticker, date_trunc('month', session) AS file, low, close, session FROM bars WHERE session <= DATE '1998-10-15'), f AS (SELECT max(file) AS file FROM m), z AS (SELECT ticker, low, last_value(close) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM m WHERE file = (SELECT file FROM f)), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(c / low - 1), low) AS k FROM z) SELECT ticker, round(low, 5) AS level FROM k WHERE k = 1")
def zones_asof(spark, d):
    """Of the newest file up to a day, each name's level nearest to its last price."""
    m = bars(spark, d).where("session <= date'1998-10-15'").withColumn("file", F.trunc("session", "month"))
    m = m.join(F.broadcast(m.agg(F.max("file").alias("file"))), "file", "left_semi")
    m = m.withColumn("c", F.max_by("close", "session").over(Window.partitionBy("ticker")))
    return m.groupBy("ticker").agg(F.min(F.struct(F.abs(ratio(C("c"), C("low")) - 1).alias("far"), "low")).alias("z")).select("ticker", r("z.low", "level", 5))


@query("D36_succession_links", f"WITH {FACTS}, n AS (SELECT c_custkey AS cik, c_nationkey AS name, c_acctbal AS assets, (SELECT count(*) FROM facts WHERE cik = c_custkey) AS n FROM customer), j AS (SELECT a.cik, b.cik AS old_cik, row_number() OVER (PARTITION BY a.cik ORDER BY b.n DESC, b.cik) AS k FROM n a JOIN n b ON a.name = b.name AND a.cik <> b.cik AND b.n >= 12 AND a.assets > 0 AND b.assets / a.assets BETWEEN 0.8 AND 1.25 WHERE a.n <= 6) SELECT cik, old_cik FROM j WHERE k = 1")
def succession_links(spark, d):
    """A company with few facts and the one of its name with most, where their assets agree."""
    n = table(spark, d, "customer").select(C("c_custkey").alias("cik"), C("c_nationkey").alias("name"), C("c_acctbal").alias("assets")).join(facts(spark, d).groupBy("cik").agg(F.count("*").alias("n")), "cik", "left").na.fill(0, ["n"])
    old = n.where("n >= 12").select(C("cik").alias("old_cik"), "name", C("assets").alias("old_assets"), C("n").alias("old_n"))
    j = n.where("n <= 6 and assets > 0").join(old, "name").where("cik <> old_cik and try_divide(old_assets, assets) between 0.8 and 1.25")
    return j.groupBy("cik").agg(F.min(F.struct((-C("old_n")).alias("o"), "old_cik")).alias("x")).select("cik", C("x.old_cik").alias("old_cik"))


YEARS = "fy AS (SELECT cik, CAST(year(filed) AS INT) AS y, sum(value) AS rev, sum(value) FILTER (form = 'O') AS rec, sum(value) FILTER (form = 'F') AS net, max(value) AS assets, min(value) AS debt, avg(value) AS ppe, count(*) AS n FROM facts GROUP BY 1, 2)"


def years(spark, d):
    """Company years: totals of orders stand for the statement's lines."""
    f = facts(spark, d)
    part = lambda form: F.sum(F.when(C("form") == form, C("value")))
    return f.groupBy("cik", F.year("filed").alias("y")).agg(F.sum("value").alias("rev"), part("O").alias("rec"), part("F").alias("net"), F.max("value").alias("assets"), F.min("value").alias("debt"), F.avg("value").alias("ppe"), F.count("*").alias("n"))


@query("D40_year_over_year", f"WITH {FACTS}, {YEARS} SELECT a.cik, a.y, round(a.rev / b.rev - 1, 6) AS growth FROM fy a LEFT JOIN fy b ON b.cik = a.cik AND b.y = a.y - 1")
def year_over_year(spark, d):
    y = years(spark, d)
    before = y.select("cik", (C("y") + 1).alias("y"), C("rev").alias("old"))
    return y.join(before, ["cik", "y"], "left").select("cik", "y", r(ratio(C("rev"), C("old")) - 1, "growth"))


M = "-4.84 + 0.920 * ((a.rec / a.rev) / (b.rec / b.rev)) + 0.528 * ((b.net / b.rev) / (a.net / a.rev)) + 0.404 * ((1 - (a.debt + a.ppe) / a.assets) / (1 - (b.debt + b.ppe) / b.assets)) + 0.892 * (a.rev / b.rev) + 0.115 * ((b.debt / (b.debt + b.ppe)) / (a.debt / (a.debt + a.ppe))) - 0.172 + 4.679 * ((a.net - a.rec) / a.assets) - 0.327 * ((a.debt / a.assets) / (b.debt / b.assets))"


@query("E71_beneish_m", f"WITH {FACTS}, {YEARS} SELECT a.cik, a.y, round(greatest(-15.0, least(15.0, {M})), 4) AS m FROM fy a JOIN fy b ON b.cik = a.cik AND b.y = a.y - 1 WHERE a.rec > 0 AND b.rec > 0 AND a.net > 0 AND b.net > 0 AND b.assets <> b.debt + b.ppe")
def beneish(spark, d):
    y = years(spark, d)
    b = y.select("cik", (C("y") + 1).alias("y"), *[C(c).alias(f"p_{c}") for c in ("rev", "rec", "net", "assets", "debt", "ppe")])
    lines = {"receivables": "rec", "revenue": "rev", "gross_profit": "net", "assets_current": "debt", "ppe": "ppe", "assets": "assets", "dna": "debt", "liabilities": "debt", "net_income": "net", "cfo": "rec"}
    j = y.join(b, ["cik", "y"]).where("rec > 0 and p_rec > 0 and net > 0 and p_net > 0 and p_assets <> p_debt + p_ppe")
    return j.select("cik", "y", r(ac.beneish_m({k: C(v) for k, v in lines.items()}, {k: C(f"p_{v}") for k, v in lines.items()}), "m", 4))


@query("E72_derived_concepts", f"WITH {FACTS}, {YEARS} SELECT cik, y, round(coalesce(net, 0) - debt, 2) AS free_cash, round(debt + coalesce(rec, 0), 2) AS total_debt, round(coalesce(rec, 0.5 * rev), 2) AS working, round(CASE WHEN net IS NULL AND rec IS NULL THEN NULL ELSE coalesce(net, 0) + coalesce(rec, 0) END, 2) AS reported FROM fy")
def derived_concepts(spark, d):
    """Concepts made of others: sums of what is there, and stand-ins where the first choice is missing."""
    out = ac.derive({"net_income": C("net"), "debt": C("debt"), "receivables": C("rec"), "revenue": C("rev")})
    return years(spark, d).select("cik", "y", *[r(v, k, 2) for k, v in out.items()])


@query("E77_row_consistency", f"WITH {FACTS}, {YEARS}, p AS (SELECT cik, y, rev / n AS price, net / n AS eps FROM fy) SELECT cik, y, CASE WHEN eps IS NULL THEN 'no eps' WHEN price / eps > 4 THEN 'pe off' ELSE 'ok' END AS verdict FROM p")
def row_consistency(spark, d):
    """A price-earnings figure against price and earnings of one row."""
    p = years(spark, d).select("cik", "y", (ratio(C("rev"), C("n"))).alias("price"), (ratio(C("net"), C("n"))).alias("eps"))
    return p.select("cik", "y", F.when(C("eps").isNull(), "no eps").when(ratio(C("price"), C("eps")) > 4, "pe off").otherwise("ok").alias("verdict"))


@query("E66_anchored_periods", f"""WITH RECURSIVE {FACTS}, e AS (SELECT DISTINCT cik, filed FROM facts), k AS (SELECT cik, min(filed) AS anchor FROM e GROUP BY 1 UNION ALL SELECT k.cik, (SELECT min(e.filed) FROM e WHERE e.cik = k.cik AND e.filed > k.anchor + 45) FROM k WHERE k.anchor IS NOT NULL)
SELECT e.cik, e.filed, max(k.anchor) AS anchor FROM e JOIN k ON k.cik = e.cik AND k.anchor <= e.filed GROUP BY 1, 2""")
def anchored_periods(spark, d):
    """Periods within 45 days of the first of their group belong to it; the next one begins a group."""
    return ac.anchored(facts(spark, d).select("cik", "filed").distinct(), "cik", "filed", 45)


@query("E106_ttm_invariants", f"WITH {FACTS}, q AS (SELECT DISTINCT cik, ddate FROM facts), l AS (SELECT cik, ddate, lag(ddate, 3) OVER f AS first, lag(ddate) OVER f AS before FROM q WINDOW f AS (PARTITION BY cik ORDER BY ddate)) SELECT cik, ddate, CASE WHEN first IS NULL THEN 'short' WHEN date_diff('day', first, ddate) BETWEEN 260 AND 290 THEN 'whole' ELSE 'gap' END AS verdict, coalesce(date_diff('day', before, ddate) < 80, false) AS overlap FROM l")
def ttm_invariants(spark, d):
    """A trailing year is four quarter ends that follow each other."""
    q = facts(spark, d).select("cik", "ddate").distinct()
    f = Window.partitionBy("cik").orderBy("ddate")
    span = F.datediff("ddate", F.lag("ddate", 3).over(f))
    return q.select("cik", "ddate", F.when(span.isNull(), "short").when(span.between(260, 290), "whole").otherwise("gap").alias("verdict"), F.coalesce(F.datediff("ddate", F.lag("ddate").over(f)) < 80, F.lit(False)).alias("overlap"))


# ---- scores and studies

RANKED = f"WITH {BARS}, m AS (SELECT ticker, session, close / lag(close, 5) OVER ({T}) - 1 AS mom, -(high - low) / close AS calm, close * volume AS size, lead(close, 5) OVER ({T}) / lead(open) OVER ({T}) - 1 AS fwd FROM bars)"


def pct(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY {v} ASC NULLS LAST) - rank() OVER (PARTITION BY session ORDER BY {v} DESC NULLS LAST) + count({v}) OVER (PARTITION BY session) + 1) / 2 / count({v}) OVER (PARTITION BY session) END"


def metrics(spark, d):
    b = bars(spark, d)
    return b.select("ticker", "session", (ratio(C("close"), F.lag("close", 5).over(w.order())) - 1).alias("mom"), (ratio(-(C("high") - C("low")), C("close"))).alias("calm"), (C("close") * C("volume")).alias("size"), w.forward_return(5).alias("fwd"))


@query("E92_combo_score", f"{RANKED}, p AS (SELECT ticker, session, 100 * {pct('mom')} AS a, 100 - 100 * {pct('calm')} AS b, 100 * {pct('size')} AS c FROM m), t AS (SELECT *, (CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END) AS theme FROM p) SELECT ticker, session, round((theme * 2.5 + c * 4.0) / 6.5, 5) AS score, round(((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) / 3.0, 5) AS coverage FROM t WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2")
def combo_score(spark, d):
    """Percentile ranks, turned by their sign, averaged by theme, themes weighted by their evidence; half the metrics at least."""
    m = dealt(metrics(spark, d), parts(spark, d), "session")
    ranks = m.select("ticker", "session", (100 * rank_pct("mom", "session")).alias("a"), (100 - 100 * rank_pct("calm", "session")).alias("b"), (100 * rank_pct("size", "session")).alias("c"))
    held = lambda *cs: sum((C(x).isNotNull().cast("int") for x in cs[1:]), C(cs[0]).isNotNull().cast("int"))
    mean = lambda *cs: ratio(sum((F.coalesce(C(x), F.lit(0.0)) for x in cs[1:]), F.coalesce(C(cs[0]), F.lit(0.0))), held(*cs))
    themes = {"pace": (mean("a", "b"), 2.5), "size": (C("c"), 4.0)}
    num = sum((F.coalesce(v * k, F.lit(0.0)) for v, k in list(themes.values())[1:]), F.coalesce(themes["pace"][0] * 2.5, F.lit(0.0)))
    den = sum((F.when(v.isNotNull(), k).otherwise(0.0) for v, k in list(themes.values())[1:]), F.when(themes["pace"][0].isNotNull(), 2.5).otherwise(0.0))
    return ranks.where(held("a", "b", "c") >= 2).select("ticker", "session", r(ratio(num, den), "score", 5), r(held("a", "b", "c") / 3.0, "coverage", 5))


@query("E95_module_melt", f"{RANKED} SELECT ticker, session, metric, round(value, 6) AS value FROM (SELECT ticker, session, mom, calm FROM m) UNPIVOT (value FOR metric IN (mom, calm))")
def module_melt(spark, d):
    return metrics(spark, d).unpivot(["ticker", "session"], ["mom", "calm"], "metric", "value").where("value is not null").select("ticker", "session", "metric", r("value", "value"))


@query("E99_shortlist_evaluate", f"{RANKED}, l AS (SELECT ticker, session, fwd FROM m WHERE mom > 0.4), done AS (SELECT ticker, session FROM l WHERE session < DATE '1998-01-01') SELECT l.ticker, l.session, round(fwd, 6) AS ret FROM l ANTI JOIN done USING (ticker, session) WHERE fwd IS NOT NULL")
def shortlist_evaluate(spark, d):
    """Listed names whose outcome is not in the ledger yet, and what they earned."""
    listed = metrics(spark, d).where("mom > 0.4").select("ticker", "session", "fwd")
    done = listed.where("session < date'1998-01-01'").select("ticker", "session")
    return listed.join(done, ["ticker", "session"], "left_anti").where("fwd is not null").select("ticker", "session", r("fwd", "ret"))


@query("E29_neutral_spread", f"{RANKED}, k AS (SELECT session, fwd, ntile(3) OVER (PARTITION BY session ORDER BY mom, ticker) AS s, ntile(3) OVER (PARTITION BY session ORDER BY size, ticker) AS c FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL), g AS (SELECT session, c, avg(fwd) FILTER (s = 3) - avg(fwd) FILTER (s = 1) AS gap FROM k GROUP BY 1, 2) SELECT session, round(avg(gap), 6) AS spread, count(gap) AS thirds FROM g GROUP BY 1 HAVING count(gap) > 0")
def neutral_spread(spark, d):
    """Top third less bottom third inside each third of a control, averaged."""
    third = lambda v: F.ntile(3).over(Window.partitionBy("session").orderBy(v, "ticker"))
    k = metrics(spark, d).where("mom is not null and fwd is not null").withColumn("s", third("mom")).withColumn("c", third("size"))
    g = k.groupBy("session", "c").agg((F.avg(F.when(C("s") == 3, C("fwd"))) - F.avg(F.when(C("s") == 1, C("fwd")))).alias("gap"))
    return g.groupBy("session").agg(r(F.avg("gap"), "spread"), F.count("gap").alias("thirds")).where("thirds > 0")


@query("E103_coupling_ic", f"{RANKED}, {CALENDAR}, {SECTORS}, n AS (SELECT m.session, mom - avg(mom) OVER (PARTITION BY m.session, sector) AS x, fwd - avg(fwd) OVER (PARTITION BY m.session, sector) AS y FROM m JOIN sectors USING (ticker) JOIN cal USING (session) WHERE mom IS NOT NULL AND fwd IS NOT NULL AND session_idx % 21 = 1), q AS (SELECT session, {pct('x')} AS rx, {pct('y')} AS ry FROM n) SELECT session, round(corr(rx, ry), 6) AS ic, count(*) AS n FROM q GROUP BY 1 HAVING count(*) >= 8")
def coupling_ic(spark, d):
    """Rank correlation inside sectors on dates 21 sessions apart."""
    dates = calendar(spark, d).where("session_idx % 21 = 1").select("session")
    n = metrics(spark, d).where("mom is not null and fwd is not null").join(dates, "session").join(sectors(spark, d), "ticker")
    inner = lambda v: C(v) - F.avg(v).over(Window.partitionBy("session", "sector"))
    n = n.select("session", inner("mom").alias("x"), inner("fwd").alias("y")).select("session", rank_avg("x", "session").alias("rx"), rank_avg("y", "session").alias("ry"))
    return n.groupBy("session").agg(r(correlation("rx", "ry"), "ic"), F.count("*").alias("n")).where("n >= 8")


@query("E118_hot_at_support", f"{RANKED}, k AS (SELECT *, ntile(3) OVER (PARTITION BY session ORDER BY mom, ticker) AS s, calm < -0.5 AS near FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT session, round(avg(fwd) FILTER (near) - avg(fwd) FILTER (NOT near), 6) AS gap FROM k WHERE s = 3 GROUP BY 1 HAVING count(*) FILTER (near) > 0 AND count(*) FILTER (NOT near) > 0")
def hot_at_support(spark, d):
    k = metrics(spark, d).where("mom is not null and fwd is not null").withColumn("s", F.ntile(3).over(Window.partitionBy("session").orderBy("mom", "ticker"))).where("s = 3").withColumn("at", C("calm") < -0.5)
    g = k.groupBy("session").agg(F.avg(F.when(C("at"), C("fwd"))).alias("a"), F.avg(F.when(~C("at"), C("fwd"))).alias("b"))
    return g.where("a is not null and b is not null").select("session", r(C("a") - C("b"), "gap"))


@query("E17_random_vs_screen", f"{RANKED}, x AS (SELECT fwd, mom > 0.3 AS picked FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL), a AS (SELECT avg(fwd) FILTER (picked) AS ma, avg(fwd) FILTER (NOT picked) AS mb, var_samp(fwd) FILTER (picked) / count(*) FILTER (picked) AS va, var_samp(fwd) FILTER (NOT picked) / count(*) FILTER (NOT picked) AS vb, avg((fwd > 0)::INT) FILTER (picked) AS wa, avg((fwd > 0)::INT) FILTER (NOT picked) AS wb FROM x) SELECT round(ma, 6) AS picked, round(mb, 6) AS rest, round((ma - mb) / sqrt(va + vb), 5) AS t, round(wa, 6) AS win_picked, round(wb, 6) AS win_rest FROM a")
def random_vs_screen(spark, d):
    from barloom.functions.ranks import welch_t

    x = metrics(spark, d).where("mom is not null and fwd is not null").withColumn("picked", C("mom") > 0.3)
    side = lambda v, keep: F.avg(F.when(C("picked") == keep, v))
    win = (C("fwd") > 0).cast("double")
    return x.agg(r(side(C("fwd"), True), "picked"), r(side(C("fwd"), False), "rest"), r(welch_t(C("fwd"), C("picked")), "t", 5), r(side(win, True), "win_picked"), r(side(win, False), "win_rest"))


@query("E19_replay_summary", f"{RANKED}, {SECTORS} SELECT sector, count(*) AS n, round(avg(fwd), 6) AS mean, round(max(fwd), 6) AS best, round(min(fwd), 6) AS worst FROM m JOIN sectors USING (ticker) WHERE mom > 0.2 AND fwd IS NOT NULL GROUP BY 1")
def replay_summary(spark, d):
    x = metrics(spark, d).where("mom > 0.2 and fwd is not null").join(sectors(spark, d), "ticker")
    return x.groupBy("sector").agg(F.count("*").alias("n"), r(F.avg("fwd"), "mean"), r(F.max("fwd"), "best"), r(F.min("fwd"), "worst"))


MONTHS = "mo AS (SELECT sector, m, sum(v) / count(v) AS v FROM (SELECT sector, date_trunc('month', session)::DATE AS m, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY session)) AS v FROM bars JOIN sectors USING (ticker)) WHERE v IS NOT NULL GROUP BY 1, 2)"


def months(spark, d):
    x = bars(spark, d).join(sectors(spark, d), "ticker").select("sector", F.trunc("session", "month").alias("m"), F.ln(ratio(C("close"), F.lag("close").over(w.order()))).alias("v"))
    return x.where("v is not null").groupBy("sector", "m").agg(F.avg("v").alias("v"))


@query("E44_permutation_persistence", f"""WITH {BARS}, {SECTORS}, {MONTHS}, s AS (SELECT 0 AS rep, sector, m, v FROM mo UNION ALL SELECT rep, a.sector, b.m, a.v FROM (SELECT rep, sector, v, row_number() OVER (PARTITION BY rep, sector ORDER BY md5(rep || '|' || sector || '|' || m), m) AS k FROM mo, range(1, 21) t(rep)) a JOIN (SELECT sector, m, row_number() OVER (PARTITION BY sector ORDER BY m) AS k FROM mo) b ON a.sector = b.sector AND a.k = b.k),
t AS (SELECT rep, sector, m, rank() OVER (PARTITION BY rep, m ORDER BY v DESC) <= 2 AS top FROM s), n AS (SELECT rep, top, lag(top) OVER (PARTITION BY rep, sector ORDER BY m) AS before FROM t), p AS (SELECT rep, avg(top::INT) AS stay FROM n WHERE before GROUP BY 1)
SELECT round(max(stay) FILTER (rep = 0), 6) AS stay, round(avg(stay) FILTER (rep > 0), 6) AS shuffled, round(avg((stay >= (SELECT stay FROM p WHERE rep = 0))::INT) FILTER (rep > 0), 6) AS p FROM p""")
def permutation_persistence(spark, d, replicates: int = 20):
    """How often a leading group leads again next month, against its months shuffled by hash, twenty times."""
    mo = months(spark, d)
    order = Window.partitionBy("sector").orderBy("m")
    places = mo.select("sector", "m", F.row_number().over(order).alias("k"))
    reps = mo.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    mixed = F.md5(F.concat_ws("|", C("rep").cast("string"), "sector", C("m").cast("string")).cast("binary"))
    reps = reps.withColumn("k", F.row_number().over(Window.partitionBy("rep", "sector").orderBy(mixed, "m"))).drop("m").join(places, ["sector", "k"])
    both = mo.withColumn("rep", F.lit(0)).select("rep", "sector", "m", "v").unionByName(reps.select("rep", "sector", "m", "v"))
    t = both.withColumn("top", F.rank().over(Window.partitionBy("rep", "m").orderBy(F.desc("v"))) <= 2)
    t = t.withColumn("before", F.lag("top").over(Window.partitionBy("rep", "sector").orderBy("m"))).where("before")
    p = t.groupBy("rep").agg(F.avg(C("top").cast("double")).alias("stay"))
    own = F.broadcast(p.where("rep = 0").select(C("stay").alias("own")))  # one row
    again = p.crossJoin(own)
    return again.agg(r(F.max("own"), "stay"), r(F.avg(F.when(C("rep") > 0, C("stay"))), "shuffled"), r(F.avg(F.when(C("rep") > 0, (C("stay") >= C("own")).cast("double"))), "p"))


@query("E47_pair_forecast", f"""WITH {BARS}, {SECTORS}, {MONTHS}, z AS (SELECT sector, m, v, (v - avg(v) OVER (PARTITION BY m)) / stddev_samp(v) OVER (PARTITION BY m) AS z FROM mo), n AS (SELECT *, dense_rank() OVER (ORDER BY m) AS k FROM z), j AS (SELECT a.sector AS lead, b.sector AS follow, a.k, a.z AS za, b.v AS vb FROM n a JOIN n b ON b.k = a.k + 1 AND a.sector <> b.sector),
t AS (SELECT lead, follow, sign(corr(za, vb)) AS s FROM j WHERE k <= 40 GROUP BY 1, 2) SELECT follow, k, round(avg(s * za), 6) AS forecast, round(any_value(vb), 6) AS came FROM j JOIN t USING (lead, follow) WHERE k > 40 GROUP BY 1, 2""")
def pair_forecast(spark, d):
    """Each group's next month from the others' standing, with the sign of their past link; signs come from the first 40 months."""
    by_month = Window.partitionBy("m")
    mo = months(spark, d)
    place = mo.select("m").distinct().withColumn("k", F.row_number().over(Window.orderBy("m")))  # months grow with time alone
    n = mo.withColumn("z", ratio(C("v") - F.avg("v").over(by_month), F.stddev_samp("v").over(by_month))).join(place, "m")
    a = n.select(C("sector").alias("lead"), "k", C("z").alias("za"))
    b = n.select(C("sector").alias("follow"), (C("k") - 1).alias("k"), C("v").alias("vb"))
    j = a.join(b, "k").where("lead <> follow")
    t = j.where("k <= 40").groupBy("lead", "follow").agg(F.signum(correlation("za", "vb")).alias("s"))
    return j.where("k > 40").join(t, ["lead", "follow"]).groupBy("follow", "k").agg(r(F.avg(C("s") * C("za")), "forecast"), r(F.max("vb"), "came")).withColumn("k", C("k").cast("long"))


@query("E132_case_extract", f"{RANKED}, q AS (SELECT ticker, session, ntile(10) OVER (PARTITION BY session ORDER BY fwd, ticker) AS dec FROM m WHERE fwd IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY dec ORDER BY session DESC, ticker) AS k FROM q WHERE dec IN (1, 10)) SELECT CASE dec WHEN 10 THEN 'best' ELSE 'worst' END AS label, ticker, session FROM k WHERE k <= 12")
def case_extract(spark, d):
    """The newest twelve of the best and of the worst tenth."""
    q = metrics(spark, d).where("fwd is not null").withColumn("dec", F.ntile(10).over(Window.partitionBy("session").orderBy("fwd", "ticker"))).where("dec in (1, 10)")
    k = q.withColumn("k", F.row_number().over(Window.partitionBy("dec").orderBy(F.desc("session"), "ticker"))).where("k <= 12")
    return k.select(F.when(C("dec") == 10, "best").otherwise("worst").alias("label"), "ticker", "session")


@query("E133_held_out_scoring", f"{RANKED}, s AS (SELECT sign(corr(mom, fwd)) AS a, sign(corr(calm, fwd)) AS b FROM m WHERE session < DATE '1998-01-01' AND mom IS NOT NULL AND fwd IS NOT NULL) SELECT ticker, session, round(a * mom + b * calm, 6) AS score FROM m, s WHERE session >= DATE '2000-01-01' AND mom IS NOT NULL")
def held_out_scoring(spark, d):
    """Signs fitted on the first years score the sessions after a gap."""
    m = metrics(spark, d)
    s = m.where("session < date'1998-01-01' and mom is not null and fwd is not null").agg(F.signum(correlation("mom", "fwd")).alias("a"), F.signum(correlation("calm", "fwd")).alias("b"))
    return m.where("session >= date'2000-01-01' and mom is not null").crossJoin(F.broadcast(s)).select("ticker", "session", r(C("a") * C("mom") + C("b") * C("calm"), "score"))


# ---- state


@query("G8_dropped_off", f"WITH {BARS}, l AS (SELECT ticker, max(session) AS last FROM bars GROUP BY 1), m AS (SELECT max(last) AS m FROM l) SELECT ticker, last FROM l, m WHERE last < m - 7")
def dropped_off(spark, d):
    last = bars(spark, d).groupBy("ticker").agg(F.max("session").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("m")))).where(C("last") < F.date_sub("m", 7)).select("ticker", "last")


@query("J3_gap_backfill", f"WITH {BARS}, {CALENDAR}, h AS (SELECT DISTINCT session FROM bars WHERE volume > 60), g AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS turn FROM cal ANTI JOIN h USING (session)) SELECT session, turn FROM g WHERE turn <= 25")
def gap_backfill(spark, d):
    """The newest session first, then the missing ones, as many as a run's budget allows."""
    held = bars(spark, d).where("volume > 60").select("session").distinct()
    g = up.missing_sessions(calendar(spark, d), held).select("session")
    return g.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("session"))).cast("long")).where("turn <= 25")


@query("J9_settled_days", "WITH dd AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS pending, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(day) AS first_open FROM dd WHERE pending > n * 0.5) SELECT day, pending <= n * 0.5 AS settled, coalesce(day < first_open, true) AS below_mark FROM dd, b")
def settled_days(spark, d):
    """A day settles when its filings are resolved; the mark stands before the first open day."""
    dd = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(C("event_type") == "error").alias("pending"), F.count("*").alias("n"))
    opened = dd.where("pending > n * 0.5").agg(F.min("day").alias("first_open"))
    return dd.crossJoin(F.broadcast(opened)).select("day", (C("pending") <= C("n") * 0.5).alias("settled"), F.coalesce(C("day") < C("first_open"), F.lit(True)).alias("below_mark"))


CATCH = "SELECT session FROM (SELECT session, (SELECT max(session_idx) FROM cal) - session_idx AS back FROM cal) WHERE back % {stride} = 0 AND session >= DATE '{floor}' AND session NOT IN (SELECT session FROM bars WHERE volume > {least})"


def catch_up(spark, d, stride, floor, least):
    """Every stride-th session, counted from the newest, that the store lacks."""
    c = calendar(spark, d)
    newest = c.agg(F.max("session_idx").alias("top"))
    wanted = c.crossJoin(F.broadcast(newest)).where(((C("top") - C("session_idx")) % stride == 0) & (C("session") >= floor)).select("session")
    return up.missing_sessions(wanted, bars(spark, d).where(C("volume") > least))


@query("J15_catch_up", f"WITH {BARS}, {CALENDAR} {CATCH.format(stride=5, floor='1996-01-01', least=60)}")
def catch_up_builder(spark, d):
    return catch_up(spark, d, 5, "1996-01-01", 60)


@query("J21_module_catch_up", f"WITH {BARS}, {CALENDAR} {CATCH.format(stride=21, floor='1999-01-01', least=80)}")
def module_catch_up(spark, d):
    return catch_up(spark, d, 21, "1999-01-01", 80)


@query("J22_flag_catch_up", f"WITH {BARS}, {CALENDAR}, {SECTORS}, mi AS ({CATCH.format(stride=10, floor='1998-01-01', least=70)}) SELECT ticker, session FROM bars JOIN mi USING (session) WHERE close > open * 1.2")
def flag_catch_up(spark, d):
    """Missed sessions are screened from stored bars."""
    return bars(spark, d).join(catch_up(spark, d, 10, "1998-01-01", 70), "session").where("close > open * 1.2").select("ticker", "session")


@query("J18_run_watermark", f"WITH {FACTS}, m AS (SELECT max(filed) AS m FROM facts) SELECT filed, count(*) AS n, bool_and(form <> 'P') AS settled FROM facts, m WHERE filed > m - 120 GROUP BY 1")
def run_watermark(spark, d):
    """Days of the last 120 with filings, and whether all of them are resolved."""
    f = facts(spark, d)
    newest = F.broadcast(f.agg(F.max("filed").alias("m")))
    return f.crossJoin(newest).where(C("filed") > F.date_sub("m", 120)).groupBy("filed").agg(F.count("*").alias("n"), F.bool_and(C("form") != "P").alias("settled"))
