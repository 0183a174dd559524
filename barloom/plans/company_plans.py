"""Queries over bitemporal facts: what was known, trailing years, repaired quarters, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_avg, ratio, safe_divide, sum_reported
from barloom.operators import accounting as ac
from barloom.operators.asof import latest_by
from barloom.plans.catalog import query, r
from barloom.sources.roles import FACTS, facts, table

#: The five concepts of the role mapping.
CONCEPTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ASOF = "1999-06-30"
KNOWN = f"k AS (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY ddate DESC, filed DESC, adsh DESC) AS n FROM facts WHERE filed <= DATE '{ASOF}' AND ddate <= DATE '{ASOF}')"
NAMES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "open", "5-LOW": "low"}


@query("E58_facts_asof", f"WITH {FACTS}, {KNOWN} SELECT cik, concept, ddate, filed, adsh, value FROM k WHERE n = 1")
def known_facts(spark, d):
    return ac.facts_asof(facts(spark, d), ASOF).select("cik", "concept", "ddate", "filed", "adsh", "value")


@query("E62_facts_wide", f"WITH {FACTS}, {KNOWN} SELECT cik, " + ", ".join(f"max(value) FILTER (concept = '{c}') AS {n}" for c, n in NAMES.items()) + " FROM k WHERE n = 1 GROUP BY 1")
def facts_wide(spark, d):
    wide = ac.wide(ac.facts_asof(facts(spark, d), ASOF), list(NAMES))
    return wide.select("cik", *[F.col(f"`{c}`").alias(n) for c, n in NAMES.items()])


@query("E65_history", f"WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY cik, concept, ddate ORDER BY filed DESC, adsh DESC) AS n FROM facts) SELECT cik, ddate, " + ", ".join(f"max(value) FILTER (concept = '{c}') AS {n}" for c, n in NAMES.items()) + " FROM k WHERE n = 1 GROUP BY 1, 2")
def history(spark, d):
    newest = latest_by(facts(spark, d), ["cik", "concept", "ddate"], [F.desc("filed"), F.desc("adsh")])
    wide = newest.groupBy("cik", "ddate").pivot("concept", list(NAMES)).agg(F.max("value"))
    return wide.select("cik", "ddate", *[F.col(f"`{c}`").alias(n) for c, n in NAMES.items()])


@query("E61_near_periods", f"""WITH {FACTS}, f AS (SELECT cik, concept, filed AS ddate, value FROM facts), g AS (SELECT *, CASE WHEN ddate - lag(ddate) OVER w <= 16 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY cik, concept ORDER BY ddate)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY cik, concept ORDER BY ddate) AS chain FROM g) SELECT cik, concept, ddate, min(ddate) OVER (PARTITION BY cik, concept, chain) AS period FROM c""")
def near_periods(spark, d):
    f = facts(spark, d).select("cik", "concept", F.col("filed").alias("ddate"), "value")
    return ac.near_periods(f).select("cik", "concept", "ddate", "period")


#: Facts with durations: every quarter's sum by company and concept, and each calendar year's as an annual fact filed a
#: month after; years to date come with the second quarter.
DURATIONS = f"""{FACTS}, q AS (SELECT cik, concept, ddate, 1 AS qtrs, sum(value) AS value, max(filed) AS filed FROM facts GROUP BY 1, 2, 3),
h AS (SELECT cik, concept, make_date(CAST(year(ddate) AS INT), 6, 30) AS ddate, 2 AS qtrs, sum(value) AS value, max(filed) AS filed FROM q WHERE quarter(ddate) <= 2 GROUP BY 1, 2, 3 HAVING count(*) = 2),
y AS (SELECT cik, concept, make_date(CAST(year(ddate) AS INT), 12, 31) AS ddate, 4 AS qtrs, sum(value) AS value, max(filed) AS filed FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 3),
d AS (SELECT * FROM q UNION ALL SELECT * FROM h UNION ALL SELECT * FROM y)"""


def durations(spark, d):
    q = facts(spark, d).groupBy("cik", "concept", "ddate").agg(F.sum("value").alias("value"), F.max("filed").alias("filed")).withColumn("qtrs", F.lit(1))
    add = lambda rows, day, n, least, most: rows.groupBy("cik", "concept", F.expr(day).alias("ddate")).agg(F.sum("value").alias("value"), F.max("filed").alias("filed"), F.count("*").alias("n")).where(f"n between {least} and {most}").drop("n").withColumn("qtrs", F.lit(n))
    half = add(q.where("quarter(ddate) <= 2"), "make_date(year(ddate), 6, 30)", 2, 2, 2)
    year = add(q, "make_date(year(ddate), 12, 31)", 4, 3, 4)
    return q.unionByName(half).unionByName(year)


@query("E60_trailing_year", f"""WITH {DURATIONS}, a AS (SELECT cik, concept, ddate AS e, value, 0 AS how FROM d WHERE qtrs = 4),
s AS (SELECT n.cik, n.concept, n.ddate AS e, n.qtrs, n.value AS now, p.value AS prior FROM d n JOIN d p ON n.cik = p.cik AND n.concept = p.concept AND n.qtrs = p.qtrs AND floor((n.ddate - p.ddate) / 91.3125 + 0.5) = 4 WHERE n.qtrs BETWEEN 1 AND 3),
b AS (SELECT s.cik, s.concept, s.e, a.value + s.now - s.prior AS value, 1 AS how FROM s JOIN a ON a.cik = s.cik AND a.concept = s.concept AND a.e < s.e AND floor((s.e - a.e) / 91.3125 + 0.5) = s.qtrs),
w AS (SELECT cik, concept, ddate AS e, sum(value) OVER f AS value, count(*) OVER f AS n, ddate - lag(ddate, 3) OVER (PARTITION BY cik, concept ORDER BY ddate) AS span FROM d WHERE qtrs = 1 WINDOW f AS (PARTITION BY cik, concept ORDER BY ddate ROWS 3 PRECEDING)),
c AS (SELECT cik, concept, e, value, 2 AS how FROM w WHERE n = 4 AND floor(span / 91.3125 + 0.5) = 3), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY e DESC, how, value DESC) AS n FROM u)
SELECT cik, concept, e AS "end", round(value, 4) AS value, how FROM k WHERE n = 1""")
def trailing_year(spark, d):
    return ac.trailing_year(durations(spark, d)).select("cik", "concept", "end", r("value", "value", 4), "how")


@query("E67_fourth_quarter", f"""WITH {DURATIONS}, x AS (SELECT * FROM d WHERE NOT (qtrs = 1 AND quarter(ddate) = 4)), i AS (SELECT y.cik, y.concept, y.ddate AS fy, y.value AS whole, count(*) AS n, sum(q.value) AS held, max(q.ddate) AS last FROM x y JOIN x q ON q.cik = y.cik AND q.concept = y.concept AND q.qtrs = 1 AND q.ddate <= y.ddate AND q.ddate > y.ddate - INTERVAL 12 MONTH WHERE y.qtrs = 4 GROUP BY 1, 2, 3, 4)
SELECT cik, concept, fy AS ddate, round(whole - held, 4) AS value FROM i WHERE n = 3 AND last < fy""")
def fourth_quarter(spark, d):
    x = durations(spark, d).where("not (qtrs = 1 and quarter(ddate) = 4)")
    return ac.fill_fourth_quarter(x).select("cik", "concept", "ddate", r("value", "value", 4))


@query("E75_surprise", f"""WITH {FACTS}, q AS (SELECT cik, 'all' AS concept, ddate, sum(value) AS value FROM facts GROUP BY 1, 2, 3), c AS (SELECT *, value - lag(value, 4) OVER (PARTITION BY cik ORDER BY ddate) AS ch FROM q)
SELECT cik, ddate, round(CASE WHEN count(ch) OVER f >= 4 AND stddev_samp(ch) OVER f > 0 AND ch IS NOT NULL THEN greatest(-10, least(10, ch / stddev_samp(ch) OVER f)) END, 4) AS sue FROM c WINDOW f AS (PARTITION BY cik ORDER BY ddate ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def surprise(spark, d):
    q = facts(spark, d).groupBy("cik", "ddate").agg(F.sum("value").alias("value")).withColumn("concept", F.lit("all"))
    return ac.surprise(q).select("cik", "ddate", r("sue", "sue", 4))


@query("E63_main_currency", f"""WITH {FACTS}, u AS (SELECT cik, CASE form WHEN 'O' THEN 'USD' WHEN 'F' THEN 'EUR/shares' ELSE 'pure' END AS uom FROM facts), c AS (SELECT cik, regexp_extract(uom, '^([A-Z]{{3}})(/shares)?$', 1) AS currency FROM u), n AS (SELECT cik, currency, count(*) AS n FROM c WHERE currency <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY n DESC, currency) AS k FROM n) SELECT cik, currency FROM k WHERE k = 1""")
def main_currency(spark, d):
    return ac.main_currency(facts(spark, d).withColumn("uom", F.expr("case form when 'O' then 'USD' when 'F' then 'EUR/shares' else 'pure' end")))


STATEMENT = f"""{FACTS}, s AS (SELECT cik, year(ddate) AS fy, sum(value) FILTER (concept = '1-URGENT') AS net_income, sum(value) FILTER (concept = '2-HIGH') AS cfo, sum(value) AS assets, sum(value) FILTER (concept = '3-MEDIUM') AS debt, sum(value) FILTER (concept = '4-NOT SPECIFIED') AS assets_current, sum(value) FILTER (concept = '5-LOW') AS liabilities_current,
CAST(count(*) AS DOUBLE) AS shares, sum(value) FILTER (form = 'O') AS gross_profit, sum(value) FILTER (form <> 'P') AS revenue FROM facts GROUP BY 1, 2)"""


def statement(spark, d):
    on = lambda c: F.sum(F.when(F.expr(c), F.col("value")))
    return facts(spark, d).groupBy("cik", F.year("ddate").alias("fy")).agg(
        on("concept = '1-URGENT'").alias("net_income"), on("concept = '2-HIGH'").alias("cfo"), F.sum("value").alias("assets"), on("concept = '3-MEDIUM'").alias("debt"), on("concept = '4-NOT SPECIFIED'").alias("assets_current"), on("concept = '5-LOW'").alias("liabilities_current"),
        F.count("*").cast("double").alias("shares"), on("form = 'O'").alias("gross_profit"), on("form <> 'P'").alias("revenue"),
    )


def pair(spark, d):
    s = statement(spark, d)
    before = s.select("cik", (F.col("fy") + 1).alias("fy"), *[F.col(c).alias(f"p_{c}") for c in s.columns[2:]])
    return s.join(before, ["cik", "fy"], "left")


def one(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


@query("E69_piotroski", f"""WITH {STATEMENT} SELECT c.cik, CAST(c.fy AS INT) AS fy, CASE WHEN c.assets IS NOT NULL AND p.assets IS NOT NULL THEN {one('c.net_income > 0')} + {one('c.cfo > 0')} + {one('c.net_income / c.assets > p.net_income / p.assets')} + {one('c.cfo > c.net_income')} + {one('c.debt / c.assets < p.debt / p.assets')}
+ {one('c.assets_current / c.liabilities_current > p.assets_current / p.liabilities_current')} + {one('c.shares <= p.shares * 1.01')} + {one('c.gross_profit / c.revenue > p.gross_profit / p.revenue')} + {one('c.revenue / c.assets > p.revenue / p.assets')} END AS f FROM s c LEFT JOIN s p ON p.cik = c.cik AND p.fy = c.fy - 1""")
def piotroski(spark, d):
    return pair(spark, d).select("cik", "fy", ac.piotroski().alias("f"))


@query("E70_altman", f"""WITH {STATEMENT} SELECT cik, CAST(fy AS INT) AS fy, round(CASE WHEN z IS NOT NULL THEN greatest(-20, least(40, z)) END, 5) AS z FROM (SELECT *, 1.2 * (assets_current - liabilities_current) / assets + 1.4 * net_income / assets + 3.3 * cfo / assets + 0.6 * (shares * 1000) / debt + revenue / assets AS z FROM s)""")
def altman(spark, d):
    s = statement(spark, d).withColumn("retained", F.col("net_income")).withColumn("ebit", F.col("cfo")).withColumn("market_cap", F.col("shares") * 1000).withColumn("liabilities", F.col("debt"))
    return s.select("cik", "fy", r(ac.altman_z(), "z", 5))


@query("I16_safe_divide", f"WITH {STATEMENT} SELECT cik, CAST(fy AS INT) AS fy, round(debt / nullif(assets_current - assets_current, 0), 6) AS none, round(debt / nullif(assets, 0), 6) AS leverage FROM s")
def divide(spark, d):
    s = statement(spark, d)
    return s.select("cik", "fy", r(safe_divide(F.col("debt"), F.col("assets_current") - F.col("assets_current")), "none"), r(safe_divide(F.col("debt"), F.col("assets")), "leverage"))


@query("I17_sum_reported", f"WITH {STATEMENT} SELECT cik, CAST(fy AS INT) AS fy, round(CASE WHEN coalesce(net_income, cfo, debt) IS NOT NULL THEN coalesce(net_income, 0) + coalesce(cfo, 0) + coalesce(debt, 0) END, 4) AS total FROM s")
def reported(spark, d):
    return statement(spark, d).select("cik", "fy", r(sum_reported(F.col("net_income"), F.col("cfo"), F.col("debt")), "total", 4))


@query("E64_proxy_rescale", f"""WITH {FACTS}, m AS (SELECT cik, concept, quantile_cont(value, 0.5) AS md FROM facts WHERE form <> 'P' GROUP BY 1, 2) SELECT adsh, round(CASE WHEN form = 'P' AND md >= 100 * (value / 1000) THEN value / 1000 * 1000 ELSE CASE WHEN form = 'P' THEN value / 1000 ELSE value END END, 4) AS value FROM facts LEFT JOIN m USING (cik, concept)""")
def proxy_rescale(spark, d):
    """Rows of proxies in thousands are brought to units where the company's other rows are 100 times larger."""
    f = facts(spark, d).withColumn("value", F.when(F.col("form") == "P", F.col("value") / 1000).otherwise(F.col("value")))
    middle = f.where("form <> 'P'").groupBy("cik", "concept").agg(F.percentile("value", F.lit(0.5)).alias("md"))
    out = f.join(middle, ["cik", "concept"], "left")
    return out.select("adsh", r(F.when((F.col("form") == "P") & (F.col("md") >= 100 * F.col("value")), F.col("value") * 1000).otherwise(F.col("value")), "value", 4))


@query("E86_peer_percentiles", f"""WITH {STATEMENT}, j AS (SELECT s.*, c_nationkey AS g FROM s JOIN customer ON c_custkey = cik WHERE fy = 1998 AND debt IS NOT NULL AND assets IS NOT NULL), k AS (SELECT cik, debt / assets AS v, g FROM j)
SELECT cik, round(CASE WHEN count(*) OVER (PARTITION BY g) >= 5 THEN (rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0) / count(*) OVER (PARTITION BY g) END, 6) AS pct FROM k""")
def peer_percentiles(spark, d):
    s = statement(spark, d).where("fy = 1998 and debt is not null and assets is not null")
    j = s.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("cik")).withColumn("v", ratio(F.col("debt"), F.col("assets")))
    n = F.count("*").over(Window.partitionBy("c_nationkey"))
    return j.select("cik", r(F.when(n >= 5, ratio(rank_avg("v", "c_nationkey"), n)), "pct"))


@query("A16_store_merge", f"""WITH {FACTS}, b AS (SELECT * FROM facts WHERE form = 'O'), c AS (SELECT * FROM facts WHERE form = 'F'), e AS (SELECT * FROM facts), bq AS (SELECT cik, date_trunc('quarter', ddate) AS q, max(filed) AS f FROM b GROUP BY 1, 2), cq AS (SELECT cik, date_trunc('quarter', ddate) AS q, max(filed) AS f FROM c GROUP BY 1, 2),
w AS (SELECT cq.cik, cq.q FROM cq LEFT JOIN bq USING (cik, q) WHERE bq.f IS NULL OR cq.f > bq.f), h AS (SELECT c.* FROM c JOIN w ON w.cik = c.cik AND w.q = date_trunc('quarter', c.ddate) UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.cik = b.cik AND w.q = date_trunc('quarter', b.ddate)))
SELECT adsh, cik, value FROM h UNION ALL SELECT adsh, cik, value FROM e WHERE adsh NOT IN (SELECT adsh FROM h)""")
def store_merge(spark, d):
    f = facts(spark, d)
    return ac.prefer_stores(f.where("form = 'O'"), f.where("form = 'F'"), f).select("adsh", "cik", "value")


@query("E108_integrity", f"""WITH {FACTS} SELECT 'filed before period' AS rule, count(*) FILTER (filed < ddate) AS bad, count(*) AS n FROM facts UNION ALL SELECT 'repeated accession', count(*) - count(DISTINCT adsh), count(*) FROM facts UNION ALL SELECT 'no value', count(*) FILTER (value IS NULL OR value <= 0), count(*) FROM facts""")
def integrity(spark, d):
    got = facts(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("filed") < F.col("ddate")).alias("a"), (F.count("*") - F.countDistinct("adsh")).alias("b"), F.count_if(F.col("value").isNull() | (F.col("value") <= 0)).alias("c"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(c).alias("bad")) for k, c in (("filed before period", "a"), ("repeated accession", "b"), ("no value", "c"))])
    return got.select("n", F.explode(rules).alias("x")).select("x.rule", "x.bad", "n")


@query("B11_shortfall", f"""WITH {FACTS}, q AS (SELECT ddate, count(DISTINCT cik) AS filers FROM facts GROUP BY 1), m AS (SELECT ddate, filers, list(filers) OVER (ORDER BY ddate ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p FROM q) SELECT ddate, filers, coalesce(len(p) >= 3 AND filers < 0.55 * list_aggregate(p, 'median'), false) AS short FROM m""")
def shortfall(spark, d):
    """Quarters are few, whatever the data."""
    q = facts(spark, d).groupBy("ddate").agg(F.countDistinct("cik").alias("filers"))
    w = Window.partitionBy(F.lit(1)).orderBy("ddate").rowsBetween(-4, -1)
    short = (F.count("filers").over(w) >= 3) & (F.col("filers") < 0.55 * F.percentile("filers", F.lit(0.5)).over(w))
    return q.select("ddate", "filers", F.coalesce(short, F.lit(False)).alias("short"))


@query("I19_duration_quarters", f"WITH {FACTS} SELECT adsh, CAST(floor((filed - ddate) / 91.3125 + 0.5) AS BIGINT) AS quarters, CASE WHEN last_day(filed) - filed < filed - (CAST(date_trunc('month', filed) AS DATE) - 1) THEN last_day(filed) ELSE CAST(date_trunc('month', filed) AS DATE) - 1 END AS month_end FROM facts")
def duration_quarters(spark, d):
    before = F.date_sub(F.trunc("filed", "month"), 1)
    nearest = F.when(F.datediff(F.last_day("filed"), "filed") < F.datediff("filed", before), F.last_day("filed")).otherwise(before)
    return facts(spark, d).select("adsh", ac.quarters_of(F.datediff("filed", "ddate")).alias("quarters"), nearest.alias("month_end"))


@query("A47_store_diff", f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE adsh % 3 <> 0), b AS (SELECT adsh, value + CASE WHEN adsh % 50 = 1 THEN 1 ELSE 0 END AS value FROM facts WHERE adsh % 3 <> 1) SELECT CASE WHEN b.adsh IS NULL THEN 'left' WHEN a.adsh IS NULL THEN 'right' WHEN a.value <> b.value THEN 'differs' ELSE 'equal' END AS side, count(*) AS n FROM a FULL JOIN b ON a.adsh = b.adsh GROUP BY 1""")
def store_diff(spark, d):
    f = facts(spark, d)
    a = f.where("adsh % 3 <> 0").select("adsh", F.col("value").alias("x"))
    b = f.where("adsh % 3 <> 1").select("adsh", F.expr("value + case when adsh % 50 = 1 then 1 else 0 end").alias("y"))
    side = F.expr("case when y is null then 'left' when x is null then 'right' when x <> y then 'differs' else 'equal' end")
    return a.join(b, "adsh", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


#: Raw lines of a supplier's year, one for each key of its order lines; what no line has is not reported.
RAW = ["revenue_ttm", "revenue", "nii_ttm", "nonint_income_ttm", "cogs_ttm", "cogs", "net_income_ttm", "net_income", "opinc_ttm", "opinc", "pretax_ttm", "pretax", "gross_profit_ttm", "cfo_ttm", "cfo", "capex_ttm", "capex", "dna_ttm", "dna", "deprec_ttm", "deprec", "amort_ttm", "amort", "tax_ttm", "tax", "interest_exp_ttm", "interest_exp", "assets", "assets_current", "liabilities", "liabilities_current", "equity", "cash", "sti", "inventory", "receivables", "payables", "retained", "ppe", "debt_lt", "debt_st", "shares_diluted", "shares_out", "shares_basic", "sbc_ttm", "sbc", "dividends_ttm", "dividends", "buybacks_ttm", "buybacks"]
LINES = f"""wide AS (SELECT l_suppkey AS cik, CAST(year(l_shipdate) AS INT) AS y, {", ".join(f"sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) FILTER (l_orderkey % {len(RAW)} = {i}) AS {c}" for i, c in enumerate(RAW))} FROM lineitem GROUP BY 1, 2)"""


def raw_lines(spark, d):
    """A supplier's year as one wide row; returned goods count against it, so that lines of either sign occur."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cik"), F.year("l_shipdate").alias("y"), F.pmod("l_orderkey", F.lit(len(RAW))).alias("k"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("v"))
    return x.groupBy("cik", "y").agg(*[F.sum(F.when(F.col("k") == i, F.col("v"))).alias(c) for i, c in enumerate(RAW)])


def derived_sql() -> str:
    yearly = lambda c: f"coalesce({c}_ttm, {c})"
    pair = lambda a, b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE coalesce({a}, 0) + coalesce({b}, 0) END"
    first = {c: f"abs({yearly(c)})" if c in ac.OUTFLOWS else yearly(c) for c in ac.YEARLY} | {c: c for c in ac.BALANCES}
    first |= {"s0": yearly("revenue"), "bank": "nii_ttm + nonint_income_ttm", "dna": f"coalesce({yearly('dna')}, {pair(yearly('deprec'), yearly('amort'))})", "cash": pair("cash", "sti"), "debt": pair("debt_lt", "debt_st"), "shares": "coalesce(shares_diluted, shares_out, shares_basic)", "gp": "gross_profit_ttm"}
    last = [*ac.YEARLY, *ac.BALANCES, "dna", "cash", "debt", "shares", "revenue"]
    more = {"gross_profit": "coalesce(gp, revenue - cogs)", "ebit": "opinc", "ebitda": "opinc + dna", "fcf": "cfo - capex", "net_debt": "debt - cash", "invested_capital": "debt + equity - cash", "tax_rate": "rate", "nopat": "opinc * (1 - rate)"}
    return f"""WITH {LINES}, a AS (SELECT cik, y, {", ".join(f"{v} AS {k}" for k, v in first.items())} FROM wide), b AS (SELECT *, CASE WHEN bank > 0 AND (s0 IS NULL OR s0 < {ac.BANK_SHARE} * bank) THEN bank ELSE s0 END AS s1 FROM a),
c AS (SELECT *, CASE WHEN net_income > 0 AND s1 < net_income AND NOT coalesce(s1 >= coalesce(opinc, pretax), false) THEN NULL ELSE s1 END AS revenue, coalesce(greatest(0.0, least(0.5, CASE WHEN pretax <> 0 THEN tax / pretax END)), 0.21) AS r0, pretax AS p0, tax AS t0 FROM b),
e AS (SELECT *, CASE WHEN p0 IS NULL OR t0 IS NULL OR p0 = 0 THEN 0.21 ELSE r0 END AS rate FROM c) SELECT cik, y, {", ".join(f"round({c}, 2) AS {c}" for c in last)}, {", ".join(f"round({v}, 4) AS {k}" for k, v in more.items())} FROM e"""


@query("E72_all_concepts", derived_sql())
def all_concepts(spark, d):
    """Every derived concept of every supplier's year."""
    x = raw_lines(spark, d)
    small = ("gross_profit", "ebit", "ebitda", "fcf", "net_debt", "invested_capital", "tax_rate", "nopat")
    return x.select("cik", "y", *[r(v, k, 4 if k in small else 2) for k, v in ac.derived(x.columns).items()])
