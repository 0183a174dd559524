"""Queries over text, arrays and nested values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ranks import correlation
from barloom.functions import text as tx
from barloom.functions.news_classes import CLASSES
from barloom.operators import levels, news
from barloom.plans.catalog import query, r
from barloom.sources.roles import bars, table

#: Headlines of the role mapping: a comment made of a part's words and an order's state.
HEADLINES = """h AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'Acme beats estimates, raises FY outlook' WHEN 1 THEN 'Beta misses Q3 EPS' WHEN 2 THEN 'Gamma prices $50M common stock offering' WHEN 3 THEN 'FDA approval for Delta' WHEN 4 THEN 'Epsilon fails to beat'
WHEN 5 THEN 'Fed holds interest rates' WHEN 6 THEN 'Zeta upgraded at broker' WHEN 7 THEN 'Eta names new CEO' ELSE 'Theta opens a plant' END AS headline, o_orderkey % 4 + 1 AS n_symbols FROM orders)"""


def headlines(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as id", """case o_orderkey % 9 when 0 then 'Acme beats estimates, raises FY outlook' when 1 then 'Beta misses Q3 EPS' when 2 then 'Gamma prices $50M common stock offering' when 3 then 'FDA approval for Delta' when 4 then 'Epsilon fails to beat'
        when 5 then 'Fed holds interest rates' when 6 then 'Zeta upgraded at broker' when 7 then 'Eta names new CEO' else 'Theta opens a plant' end as headline""", "o_orderkey % 4 + 1 as n_symbols")


def case(column: str, value) -> str:
    """The taxonomy as SQL. RE2 has no look-ahead; its one use is stated by two tests."""
    out = []
    for c in CLASSES:
        pattern = c[1].replace("'", "''")
        if "(?!" in pattern:
            first, rest = pattern.split("|", 1)
            verb = first.split("(?!")[0]
            out.append(f"WHEN (regexp_matches({column}, '(?i){verb}') AND NOT regexp_matches({column}, '(?i){verb}.*\\bmiss')) OR regexp_matches({column}, '(?i){rest}') THEN {value(c)}")
        else:
            out.append(f"WHEN regexp_matches({column}, '(?i){pattern}') THEN {value(c)}")
    return "CASE " + " ".join(out)


@query("I1_taxonomy", f"WITH {HEADLINES} SELECT id, {case('headline', lambda c: repr(c[0]))} ELSE 'OTHER' END AS event_type FROM h")
def taxonomy(spark, d):
    return news.classified(headlines(spark, d)).select("id", "event_type")


@query("I1_document_taxonomy", f"WITH h AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10))[1] AS headline FROM documents) SELECT id, {case('headline', lambda c: repr(c[0]))} ELSE 'OTHER' END AS event_type FROM h")
def document_taxonomy(spark, d):
    """The class of every document's first line, as a wire's headline is its first line."""
    h = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)).alias("headline"))
    return news.classified(h).select("id", "event_type")


@query("I3_severity", f"WITH {HEADLINES}, c AS (SELECT *, {case('headline', lambda c: repr(c[0]))} ELSE 'OTHER' END AS k, {case('headline', lambda c: repr(c[3]))} ELSE 0.8 END AS p FROM h), s AS (SELECT id, CASE WHEN k IN ('NOISE', 'MACRO') THEN 0 ELSE least(100, p * 18 / (1 + 0.25 * (n_symbols - 1))) END AS v FROM c) SELECT id, round(v, 5) AS severity, CASE WHEN v >= 45 THEN 'CRITICAL' WHEN v >= 32 THEN 'HIGH' WHEN v >= 20 THEN 'MEDIUM' WHEN v >= 10 THEN 'LOW' ELSE 'NOISE' END AS band FROM s")
def severities(spark, d):
    c = news.classified(headlines(spark, d))
    c = c.withColumn("v", tx.severity(F.col("prior"), F.lit(0.0), F.col("n_symbols"), F.col("event_type").isin("NOISE", "MACRO")))
    return c.select("id", r("v", "severity", 5), tx.severity_band(F.col("v")).alias("band"))


@query("I5_article_scores")
def article_scores(spark, d):
    s = news.scored(headlines(spark, d), summary=None)
    return s.select("id", "event_type", r("lm_score", "lm_score"), "lm_pos", "lm_neg", r("combined", "combined"), "is_company")


@query("I2_lexicon_documents")
def lexicon_documents(spark, d):
    x = table(spark, d, "documents").withColumn("x", tx.lexicon_column(news.LEXICON, "text"))
    return x.select("doc_id", r("x.score", "score"), F.col("x.n_pos").alias("n_pos"), F.col("x.n_neg").alias("n_neg"))


@query("D34_explode_symbols", "SELECT l_shipdate::DATE AS day, unnest(string_split(l_returnflag || ',' || l_linestatus, ',')) AS symbol, count(*) AS n FROM lineitem GROUP BY 1, 2")
def explode_symbols(spark, d):
    x = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("symbols"))
    return news.by_symbol(x).groupBy("day", F.col("ticker").alias("symbol")).agg(F.count("*").alias("n"))


@query("D37_entity_name", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9 ]+', ' ', 'g')) AS name FROM customer")
def entity_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.entity_name(F.col("c_name")).alias("name"))


@query("I12_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def dates(spark, d):
    """Four written forms of a day are read back."""
    o = table(spark, d, "orders")
    form = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("dd-MMM-yyyy", "yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.withColumn("t", form).select("o_orderkey", tx.any_date(F.col("t")).alias("day"))


@query("I14_amount_ranges", "SELECT p_partkey, CAST(1000 * p_size AS DOUBLE) AS low, CASE WHEN p_size % 5 <> 0 THEN CAST(5000 * p_size AS DOUBLE) END AS high FROM part")
def amounts(spark, d):
    p = table(spark, d, "part")
    low, high = F.format_number(F.col("p_size") * 1000, 0), F.format_number(F.col("p_size") * 5000, 0)
    text = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Over $"), low)).otherwise(F.concat(F.lit("$"), low, F.lit(" - $"), high))
    return p.withColumn("x", tx.amount_range(text)).select("p_partkey", "x.low", "x.high")


@query("C9_symbol", "SELECT p_partkey, translate(upper(trim(p_brand)), '#-/', '#..') AS symbol FROM part")
def symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.symbol(F.col("p_brand")).alias("symbol"))


@query("A8_column_arrays", "SELECT user_id, list(event_id ORDER BY ts, event_id)[1:5] AS first5, count(*) AS n FROM events GROUP BY 1")
def column_arrays(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("x"), F.count("*").alias("n"))
    return e.select("user_id", F.transform(F.slice("x", 1, 5), lambda x: x["event_id"]).alias("first5"), "n")


@query("E131_vector_corr", "WITH x AS (SELECT vec_id, unnest(embedding[1:32]) AS a, unnest(embedding[33:64]) AS b FROM embeddings) SELECT vec_id, round(corr(a, b), 5) AS c FROM x GROUP BY 1")
def vector_corr(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.explode(F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))).alias("z"))
    return x.select("vec_id", "z.*").toDF("vec_id", "a", "b").groupBy("vec_id").agg(r(correlation(F.col("a").cast("double"), F.col("b").cast("double")), "c", 5))


@query("E134_threshold_counts", "SELECT label, count(*) AS n, CAST(sum(CAST(list_sum(embedding) > 0 AS INT)) AS BIGINT) AS positive, CAST(sum(CAST(list_max(embedding) > 0.3 AS INT)) AS BIGINT) AS peaked FROM embeddings GROUP BY 1")
def threshold_counts(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(total > 0).alias("positive"), F.count_if(F.array_max("embedding") > 0.3).alias("peaked"))


@query("F14_pivots")
def pivots(spark, d):
    return levels.pivots(bars(spark, d)).select("ticker", "session", "kind", r("price", "price"))


@query("F16_levels")
def support_levels(spark, d):
    return levels.levels(bars(spark, d)).select("ticker", r("level", "level"), "members")


@query("F34_zones")
def zones(spark, d):
    z = levels.zones(bars(spark, d))
    return z.select("ticker", r("level", "level"), r("dist_pct", "dist_pct"), "touches", "bounces", r("bounce_median", "bounce_median"), "bars_since_touch")


@query("F36_zigzag")
def zigzag(spark, d):
    return levels.rallies(bars(spark, d)).select("ticker", "start", "end", r("gain", "gain"))


@query("F37_dips")
def dips(spark, d):
    return levels.dips(bars(spark, d)).select("ticker", "start", "end", "recovered")


@query("G5_nearest_zone")
def nearest_zone(spark, d):
    w = Window.partitionBy("ticker").orderBy("dist_pct", "level")
    return levels.zones(bars(spark, d)).withColumn("n", F.row_number().over(w)).where("n = 1").select("ticker", r("level", "level"), r("dist_pct", "dist_pct"))
